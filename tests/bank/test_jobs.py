import json

from itemforge import schema
from itemforge.operators.bank import BankStore
from itemforge.streaming.jobs import EVENT, import_stream, latest_state


def test_the_last_event_counts(spark):
    rows = spark.createDataFrame([("a", 2, 1, "rodando", "", None), ("a", 3, 3, "concluido", "", None), ("b", 1, 0, "falhou", "x", None)], EVENT)
    assert {r.job_id: r.state for r in latest_state(rows).collect()} == {"a": "concluido", "b": "falhou"}


def test_payload_files_are_imported_once(spark, tmp_path):
    question = {"numero": "1", "titulo": "t", "instituicao": "", "ano": "", "disciplina": "d", "topico": "t", "assuntos": ["a"], "etapa": None, "dificuldade": "2", "enunciado": "e", "alternativas": {"B": "y", "A": "x"}, "gabarito": "A", "pagina": "1", "observacoes": None}
    (tmp_path / "in").mkdir()
    for _ in range(2):
        (tmp_path / "in" / f"{_}.json").write_text(json.dumps({"hash_pdf": "h", "arquivo": "f", "tipo": "lista", "titulo": "T", "questoes": [question]}))
        import_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/bank", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    rows = BankStore(spark, f"file://{tmp_path}/bank").read("questions", schema.QUESTION).collect()
    assert len(rows) == 1 and rows[0].year is None and rows[0].institution is None and [o.letter for o in rows[0].options] == ["A", "B"] and rows[0].review is False
