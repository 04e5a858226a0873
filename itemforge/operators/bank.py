"""The bank: imports with a guard, upserts, virtual lists and their members.

Tables are DataFrames in and out; BankStore keeps them as Parquet in buckets with a
pointer that moves last, so a reader never sees half an import.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .assemble import ordered_distinct

QUESTION_KEY = ["hash", "number"]
#: The session's setting by which the shuffle files of a finished query go at once, and not when the driver collects garbage.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), defaults: dict[str, Column] | None = None) -> DataFrame:
    """old with the rows of new put in or over its own, and `op`: insert, update or keep.

    A null in new overwrites. Columns in keep stay as they are where a row exists;
    columns that new lacks get their default on insertion.
    """
    defaults = defaults or {}
    values = [c for c in old.columns if c not in keys]
    n = new.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_n_{c}") for c in values if c in new.columns], F.lit(True).alias("_new"))
    o = old.withColumn("_old", F.lit(True))
    on = [o[k] == n[f"_k_{k}"] for k in keys]
    both = o.join(n, on, "full")
    fresh, there = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    out = [F.coalesce(F.col(k), F.col(f"_k_{k}")).alias(k) for k in keys]
    for c in values:
        new_value = F.col(f"_n_{c}") if c in new.columns else defaults.get(c, F.lit(None))
        takes = fresh & ~there if c in keep or c not in new.columns else fresh
        out.append(F.when(takes, new_value).otherwise(F.col(c)).alias(c))
    op = F.when(fresh & there, "update").when(fresh, "insert").otherwise("keep")
    return both.select(*out, op.alias("op"))


def dropped_by_import(questions: DataFrame, payload: DataFrame) -> DataFrame:
    """(hash, numbers): stored questions of a document that its new payload lacks. Nulls
    in the payload match nothing, so they can't hide a missing question."""
    lost = questions.join(payload.select("hash").distinct(), "hash", "left_semi").join(payload.select(*QUESTION_KEY), QUESTION_KEY, "left_anti")
    return lost.groupBy("hash").agg(F.array_sort(F.collect_list("number")).alias("numbers"))


def guarded(payload: DataFrame, questions: DataFrame) -> DataFrame:
    """payload; reading any of it, or counting it, fails if it would drop stored questions
    of a document."""
    lost = dropped_by_import(questions, payload).select(F.col("hash").alias("_h"), "numbers")
    checked = payload.join(lost, payload["hash"] == lost["_h"], "left")
    stop = F.raise_error(F.concat(F.lit("the import would drop stored questions "), F.to_json("numbers"), F.lit(" of "), F.col("hash")))
    return _unless(checked, F.col("numbers").isNotNull(), stop).drop("_h", "numbers")


def _unless(df: DataFrame, bad: Column, stop: Column) -> DataFrame:
    """df; a filter, which no projection prunes, raises where bad holds."""
    return df.where(F.when(F.coalesce(bad, F.lit(False)), stop.cast("boolean")).otherwise(F.lit(True)))


def import_questions(questions: DataFrame, payload: DataFrame, now: Column | None = None) -> DataFrame:
    """Upsert by (hash, number): new ones are unpublished and created now, known ones keep both."""
    now = F.current_timestamp() if now is None else now
    return upsert(questions, guarded(payload.drop("created"), questions), QUESTION_KEY, keep=("published", "created"), defaults={"published": F.lit(False), "created": now})


def default_list_id() -> Column:
    """The id of a document's list, by its hash."""
    return F.substring(F.sha2(F.concat(F.lit("default:"), F.col("hash")), 256), 1, 32)


def default_lists(lists: DataFrame, documents: DataFrame, payload: DataFrame, now: Column | None = None) -> DataFrame:
    """Each imported document has a list of its own: its earliest, or a new one. A new one gets name,
    description and time of creation; a known one only discipline, topic, tags and time of change."""
    now = F.current_timestamp() if now is None else now
    tags = payload.groupBy("hash").agg(ordered_distinct("number", "subjects").alias("tags"))
    known = first_list_of(lists).withColumnRenamed("list_id", "_known")
    new = documents.join(tags, "hash").join(known, "hash", "left").select(F.coalesce("_known", default_list_id()).alias("list_id"), F.concat(F.lit("Lista de "), F.col("title")).alias("name"), F.concat(F.lit("Lista completa de "), F.col("title")).alias("description"), "discipline", "topic", "tags", F.lit("rascunho").alias("status"), "hash", now.alias("created"), now.alias("updated"))
    return upsert(lists, new, ["list_id"], keep=("name", "description", "status", "hash", "created"))


def add_members(members: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of positions by (list, question); nobody is removed."""
    return upsert(members, new, ["list_id", *QUESTION_KEY])


def resolve_members(request: DataFrame, questions: DataFrame) -> DataFrame:
    """(list_id, hash, number, position, found): the questions that a list asks for, the
    first place of each. request: list_id, hash, number, ord from 1."""
    first = request.groupBy("list_id", *QUESTION_KEY).agg(F.min("ord").alias("position"))
    known = questions.select(*QUESTION_KEY).withColumn("found", F.lit(True))
    return first.join(known, QUESTION_KEY, "left").select("list_id", *QUESTION_KEY, "position", F.coalesce("found", F.lit(False)).alias("found"))


def save_list(members: DataFrame, request: DataFrame, questions: DataFrame) -> DataFrame:
    """members after lists are saved: those of a saved list are replaced. Reading or
    counting it fails if a list asks for questions that the bank lacks."""
    wanted = resolve_members(request, questions)
    stop = F.raise_error(F.concat(F.lit("not in the bank: "), F.col("hash"), F.lit("/"), F.col("number").cast("string")))
    wanted = _unless(wanted, ~F.col("found"), stop).drop("found")
    others = members.join(request.select("list_id").distinct(), "list_id", "left_anti")
    return others.unionByName(wanted.select(*members.columns))


def removed_members(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """Members of the wanted lists that are no longer asked for."""
    own = members.join(wanted.select("list_id").distinct(), "list_id", "left_semi")
    return own.join(wanted, ["list_id", *QUESTION_KEY], "left_anti")


def patch(lists: DataFrame, changes: DataFrame) -> DataFrame:
    """Partial update: changes (list_id, given map<string,string>) set the columns that
    are keys of given (arrays as JSON); a key with a null value sets null, an absent one
    nothing."""
    c = changes.select(F.col("list_id").alias("_id"), "given")
    both = lists.join(c, lists["list_id"] == c["_id"], "left")
    has = lambda k: F.coalesce(F.map_contains_key("given", k), F.lit(False))
    kinds = dict(lists.dtypes)
    new = lambda k: F.from_json(F.try_element_at("given", F.lit(k)), kinds[k]) if kinds[k].startswith("array") else F.try_element_at("given", F.lit(k)).cast(kinds[k])
    out = [F.col(k) if k == "list_id" else F.when(has(k), new(k)).otherwise(F.col(k)).alias(k) for k in lists.columns]
    return both.select(*out)


def named(lists: DataFrame) -> DataFrame:
    """lists; reading or counting it fails where a name is blank."""
    return _unless(lists, F.coalesce(F.trim("name"), F.lit("")) == "", F.raise_error(F.lit("a list needs a name")))


def asked_members(saved: DataFrame) -> DataFrame:
    """(list_id, hash, number, ord from 1): what lists (with questions, an array of hash and
    number in the wanted order) ask for."""
    return saved.select("list_id", F.posexplode("questions").alias("ord", "q")).select("list_id", "q.hash", "q.number", (F.col("ord") + 1).alias("ord"))


def save_lists(lists: DataFrame, members: DataFrame, saved: DataFrame, questions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(lists, members) after whole lists are saved: the row of a list is put in or over
    the old one, whose origin and time of creation stay, and its members are replaced.
    Reading the members fails if a list asks for questions that the bank lacks."""
    filled = {"description": F.lit(""), "status": F.lit("rascunho"), "tags": F.array().cast("array<string>")}
    new = saved.select(*[F.coalesce(F.col(c), filled[c]).alias(c) if c in filled else F.col(c) for c in saved.columns if c != "questions"])
    new = new.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("discipline", "topic")}).withColumns({"created": now, "updated": now})
    out = upsert(lists, named(new), ["list_id"], keep=("created", "hash")).drop("op")
    # A saved list without questions has no row in what is asked for, but loses its members.
    rest = members.join(saved.select("list_id"), "list_id", "left_anti")
    return out, rest.unionByName(save_list(members.limit(0), asked_members(saved), questions))


def create_lists(names: DataFrame, now: Column) -> DataFrame:
    """New lists (list_id, name): empty drafts of their own, without an origin."""
    text = F.lit(None).cast("string")
    name = F.coalesce(F.col("name"), F.lit("Nova lista"))
    return names.select("list_id", name.alias("name"), F.lit("").alias("description"), text.alias("discipline"), text.alias("topic"), F.array().cast("array<string>").alias("tags"), F.lit("rascunho").alias("status"), text.alias("hash"), now.alias("created"), now.alias("updated"))


def first_list_of(lists: DataFrame) -> DataFrame:
    """(hash, list_id): the list of each import, the earliest if there are several, one without a
    time before all."""
    return lists.where("hash is not null").groupBy("hash").agg(F.min_by("list_id", F.struct("created", "list_id")).alias("list_id"))


def push_order(members: DataFrame, issues: DataFrame) -> DataFrame:
    """(list_id, hashes): the imports to send, in order, before each list. Reading or
    counting it fails if a question of a list has errors."""
    wrong = issues.where("severity = 'E'").select(*QUESTION_KEY).distinct()
    bad = members.join(wrong, QUESTION_KEY, "left_semi").groupBy("list_id").agg(F.count(F.lit(1)).alias("_bad"))
    checked = origins_in_order(members).join(bad, "list_id", "left")
    return _unless(checked, F.col("_bad") > 0, F.raise_error(F.concat(F.lit("questions with errors in the list "), F.col("list_id")))).drop("_bad")


def publish(lists: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select(F.col("list_id").alias("_id")).distinct()
    out = lists.join(hit, lists["list_id"] == hit["_id"], "left")
    return out.withColumn("status", F.when(F.col("_id").isNotNull(), "publicada").otherwise(F.col("status"))).drop("_id")


def delete_lists(lists: DataFrame, members: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists without the given ones, and members without theirs."""
    return lists.join(ids, "list_id", "left_anti"), members.join(ids, "list_id", "left_anti")


def delete_imports(imports: DataFrame, lists: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imports without the given ones; their lists stay, without an origin."""
    gone = hashes.select(F.col("hash").alias("_h")).distinct()
    left = lists.join(gone, lists["hash"] == gone["_h"], "left")
    return imports.join(hashes, "hash", "left_anti"), left.withColumn("hash", F.when(F.col("_h").isNull(), F.col("hash"))).drop("_h")


def missing_default_lists(imports: DataFrame, origins: DataFrame) -> DataFrame:
    """Imports that never had a list of their own (a deleted one doesn't come back)."""
    return imports.join(origins, "hash", "left_anti")


def origins_in_order(members: DataFrame) -> DataFrame:
    """(list_id, hashes): the documents a list draws on, in the order first met."""
    w = members.groupBy("list_id", "hash").agg(F.min("position").alias("p"))
    return w.groupBy("list_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "hash"))), lambda x: x["hash"]).alias("hashes"))


def staged_text(staging: DataFrame) -> DataFrame:
    """(batch, text): the parts of a staged payload, joined in order."""
    parts = F.array_sort(F.collect_list(F.struct("part", "text")))
    return staging.groupBy("batch").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


class BankStore:
    """The bank's tables as Parquet in hash buckets: root/<table>/w=<writer>/_bucket=<b>, and root/_current/v=<n>, which
    names the files of each bucket of each table. Files are written by Spark only; a version is
    complete before the pointer to it exists, and what is read is never overwritten, as every
    writer has a folder of its own. A bucket without rows has no files.

    A row's bucket follows from its hash, or its list_id where it has none. The number of buckets is chosen
    for a new bank (so that a bucket is some hundred MB when the bank is full) and kept.

    A version has one successor: a writer claims it by creating a file, which file systems
    do atomically, so that of two writers who read the same version one fails, unless both say which
    buckets they have read and written and these aren't the same."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self._new_buckets = spark, root.rstrip("/"), buckets

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        fs = self._files(path)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def version(self) -> int:
        fs = self._files(self._path(self.root))
        there = lambda name: fs.exists(self._path(f"{self.root}/_current/{name}/_SUCCESS"))
        return max((int(name[2:]) for name in self._names(f"{self.root}/_current") if there(name)), default=0)

    def _entries(self, n: int) -> dict[tuple[str, int], str]:
        """Where the buckets that have rows lie, as of version n: as many as tables times buckets at most."""
        if not n:
            return {}
        rows = self.spark.read.schema("name string, bucket int, path string, buckets int").parquet(f"{self.root}/_current/v={n}").collect()
        self._new_buckets = rows[0]["buckets"]
        return {(r["name"], r["bucket"]): r["path"] for r in rows if r["path"]}

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self._new_buckets)).cast("int")

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets of all keys (one column): numbers below the number of buckets."""
        self._entries(self.version())
        return sorted(r["b"] for r in keys.select(self.bucket(F.col(keys.columns[0])).alias("b")).distinct().collect())

    def read(self, table: str, schema: str, buckets: list[int] | None = None, at: int | None = None) -> DataFrame:
        """A table, or these buckets of it, as of a version, the current one if not given."""
        entries = self._entries(self.version() if at is None else at)
        paths = [f"{self.root}/{p}" for (name, b), p in sorted(entries.items()) if name == table and (buckets is None or b in buckets)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def claim(self, base: int) -> None:
        path = self._path(f"{self.root}/_claims/after={base}")
        if not self._files(path).createNewFile(path):
            raise RuntimeError(f"another writer follows version {base}; release({base}) if it has died")

    def release(self, base: int) -> None:
        path = self._path(f"{self.root}/_claims/after={base}")
        self._files(path).delete(path, False)

    @contextmanager
    def _freeing(self) -> Iterator[None]:
        """What is written within leaves no shuffle files: a version is several writes, and only one's files are there at a time."""
        before = self.spark.conf.get(FREE, None)
        self.spark.conf.set(FREE, "true")
        try:
            yield
        finally:
            self.spark.conf.unset(FREE) if before is None else self.spark.conf.set(FREE, before)

    @contextmanager
    def spool(self) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """A function that writes a table beside the bank's and reads it back, so that what several writes use is made once. Its
        tables go with the end of the block."""
        folder = f"{self.root}/_incoming/w={uuid.uuid4().hex}"

        def put(df: DataFrame) -> DataFrame:
            path = f"{folder}/{uuid.uuid4().hex}"
            with self._freeing():
                df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        try:
            yield put
        finally:
            path = self._path(folder)
            self._files(path).delete(path, True)

    def _stage(self, name: str, df: DataFrame, writer: str, touched: list[int] | None) -> dict[tuple[str, int], str]:
        """Writes df by buckets; large ones are parted among tasks. With touched, a row of another bucket is an error."""
        keys = [F.col(c).cast("string") for c in ("hash", "list_id") if c in df.columns]
        rows = df.withColumn("_bucket", self.bucket(F.coalesce(*keys)) if keys else F.lit(0))
        if touched is not None:
            rows = _unless(rows, ~F.col("_bucket").isin(touched), F.raise_error(F.lit(f"a row of {name} outside the buckets that were read")))
        folder = f"{name}/w={writer}"
        with self._freeing():
            rows.hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        return {(name, int(d.removeprefix("_bucket="))): f"{folder}/{d}" for d in self._names(f"{self.root}/{folder}") if d.startswith("_bucket=")}

    def _point(self, n: int, entries: dict[tuple[str, int], str]) -> int:
        rows = [(name, b, path, self._new_buckets) for (name, b), path in entries.items()] or [("", 0, None, self._new_buckets)]
        self.spark.createDataFrame(rows, "name string, bucket int, path string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/_current/v={n}")
        return n

    def commit(self, tables: dict[str, DataFrame], base: int | None = None, touched: dict[str, list[int]] | None = None, patience: int = 60) -> int:
        """Writes tables as the version after base (the one they were made from; the
        current one if not given), then the pointer. Tables that aren't given stay as they
        are. Any failure leaves the old version current.

        With touched (per table the buckets that were read and are given anew) all other buckets stay, and versions that
        others made since base count as read, if they changed none of these; else it is an error. The claim is
        held only while the pointer is written, so a writer waits for another one's, up to `patience` seconds."""
        base = self.version() if base is None else base
        writer = uuid.uuid4().hex
        if touched is None:
            self.claim(base)
            try:
                if self.version() != base:
                    raise RuntimeError(f"version {base} is no longer current")
                old = {k: p for k, p in self._entries(base).items() if k[0] not in tables}
                for name, df in tables.items():
                    old |= self._stage(name, df, writer, None)
                return self._point(base + 1, old)
            except BaseException:
                self.release(base)
                raise
        read = self._entries(base)
        ours = {(name, b) for name, of in touched.items() for b in of}
        new: dict[tuple[str, int], str] = {}
        for name, df in tables.items():
            new |= self._stage(name, df, writer, touched[name])
        for left in range(patience, -1, -1):
            now = self.version()
            entries = self._entries(now)
            if any(entries.get(k) != read.get(k) for k in ours):
                raise RuntimeError(f"another writer has changed the same buckets since version {base}")
            try:
                self.claim(now)
                break
            except RuntimeError:
                if not left:
                    raise
                time.sleep(1)
        try:
            return self._point(now + 1, {k: p for k, p in entries.items() if k not in ours} | new)
        except BaseException:
            self.release(now)
            raise

    def vacuum(self, keep: int = 2, hours: float = 24) -> int:
        """Deletes versions before the last `keep`, and files that no other names and that are older than `hours` (younger
        ones may be a writer's that has no version yet). Returns how many buckets' files went."""
        n = self.version()
        live = {p for v in range(max(1, n - keep + 1), n + 1) for p in self._entries(v).values()}
        fs, cut, gone = self._files(self._path(self.root)), 1000 * (time.time() - 3600 * hours), 0
        for name in [x for x in self._names(f"{self.root}/_current") if int(x[2:]) <= n - keep]:
            fs.delete(self._path(f"{self.root}/_current/{name}"), True)
        for table in [x for x in self._names(self.root) if not x.startswith("_")]:
            for part in [f"{table}/{w}/{b}" for w in self._names(f"{self.root}/{table}") for b in self._names(f"{self.root}/{table}/{w}") if b.startswith("_bucket=")]:
                path = self._path(f"{self.root}/{part}")
                if part not in live and fs.getFileStatus(path).getModificationTime() < cut:
                    gone += bool(fs.delete(path, True))
        return gone


def import_documents(store: BankStore, documents: DataFrame, payload: DataFrame, now: Column | None = None) -> int:
    """Imports documents (hash, file, kind, title, discipline, topic) with their questions
    as one new version: all or nothing, and the same again changes nothing but the time of change. All
    that is written has one time: now, or the current time. Only the buckets of these documents are read and
    written, so imports of documents in other buckets may run at the same time."""
    now = F.current_timestamp() if now is None else now
    now = F.lit(store.spark.range(1).select(now.cast("timestamp")).first()[0])
    base = store.version()
    with store.spool() as put:
        return _import(store, put, put(documents), put(payload), now, base)


def _import(store: BankStore, put: Callable[[DataFrame], DataFrame], documents: DataFrame, payload: DataFrame, now: Column, base: int) -> int:
    from .. import schema as s

    mine = store.buckets_of(documents.select("hash").unionByName(payload.select("hash")))
    # A list that has lost its origin lies by its id.
    by_list = sorted({*mine, *store.buckets_of(documents.select(default_list_id()))})
    touched = {"imports": mine, "questions": mine, "lists": by_list, "members": mine}
    kinds = {"imports": s.IMPORT, "questions": s.QUESTION, "lists": s.LIST, "members": s.MEMBER}
    imports, questions, lists, members = [store.read(name, kind, touched[name], base) for name, kind in kinds.items()]
    totals = payload.groupBy("hash").agg(F.count(F.lit(1)).cast("int").alias("total"))
    new_imports = documents.join(totals, "hash").select("hash", "file", F.coalesce("kind", F.lit("lista")).alias("kind"), "title", "total", now.alias("created"), now.alias("updated"))
    own = put(default_lists(lists, documents, payload, now))
    list_of = first_list_of(own)
    positions = payload.join(list_of, "hash").select("list_id", "hash", "number", F.col("number").alias("position"))
    return store.commit({
        "imports": upsert(imports, new_imports, ["hash"], keep=("created",)).drop("op"),
        "questions": import_questions(questions, payload, now).drop("op"),
        "lists": own.drop("op"),
        "members": add_members(members, positions).drop("op"),
    }, base, touched)


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")
