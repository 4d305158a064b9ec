"""A corpus as files: generations of chunks in JSON lines behind a log, vectors in Parquet, and the checks before they are read.

Chunks lie in buckets by the hash of their document's id. A generation is one entry of the log: for every bucket the folder
that holds it and those that changed it since, its counts and its ordered digest, and the digest of the entry before. A change writes the documents
that it puts, and the ids of those that it removes, to a new folder, and then claims the next number of the log by creating that entry's file, which
fails if it is there. So of two writers who saw the same generation one fails, and a reader sees a whole generation or the one before. Of a
document the last folder that lists it holds; a bucket that has been changed CHANGES times is written whole again.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.digests import document_digests, nodes, place
from .shared import discard, stored

VERSION = 3
CHUNK_SCHEMA = "document_id string, ordinal int, section string, text string, chunk_id string"
LISTED_SCHEMA = "document_id string, digest string, chunks bigint, words bigint"
#: Hexadecimal digits of a document's place that name its bucket; 2 give 256 buckets, whose entries the driver holds.
DIGITS = 2
#: The fields of an entry, all of which it must have and no others; a bucket that has been changed has changes too: [folder, action], in order.
ENTRY = {"version", "number", "parent", "action", "aggregate", "buckets", "digest"}
BUCKET = {"folder", "documents", "chunks", "words", "digest"}
#: Changes of a bucket that are read beside it, before one writes it whole.
CHANGES = 8
#: Files are packed fast: they are a ninth larger than by default, and written in two thirds of the time.
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


class ConcurrentUpdate(ValueError):
    """Another writer has published the generation that this one was to be."""


def chunk_identity() -> Column:
    """The id that a chunk's content gives it."""
    return T.chunk_id(F.concat_ws("|", "document_id", F.col("ordinal").cast("string"), "section", "text"))


def facts(chunks: DataFrame, *more: str) -> DataFrame:
    """chunks without their texts: (more..., document_id, ordinal, chunk_id, words, wrong), where wrong tells that the id is not that of the content."""
    return chunks.select(*more, "document_id", "ordinal", "chunk_id", (T.count_of(F.col("text"), " ") + 1).cast("bigint").alias("words"), (~F.col("chunk_id").eqNullSafe(chunk_identity())).alias("wrong"))


def faults(chunks: DataFrame) -> DataFrame:
    """(fault, document_id, ordinal): records whose id is not that of their content, repeated ids, and repeated places."""
    return record_faults(facts(chunks))


def record_faults(told: DataFrame) -> DataFrame:
    """faults() of chunks of which facts() are told."""
    wrong = told.where("wrong").select(F.lit("identity").alias("fault"), "document_id", "ordinal")
    twice = told.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("document_id"), F.min("ordinal").alias("ordinal")).where("n > 1").select(F.lit("repeated id").alias("fault"), "document_id", "ordinal")
    place = told.groupBy("document_id", "ordinal").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated place").alias("fault"), "document_id", "ordinal")
    return wrong.unionByName(twice).unionByName(place)


def listing(told: DataFrame, *more: str) -> DataFrame:
    """(more..., document_id, digest, chunks, words) over facts(): what a manifest says of every document; the digest covers its chunks in order."""
    rows = told.where("document_id is not null").select(F.struct(*more, "document_id").alias("key"), "ordinal", "chunk_id", "words")
    return document_digests(rows, "key", "ordinal", "chunk_id", "words").select("key.*", "digest", F.col("n").alias("chunks"), "words")


def _bucket(key: str = "document_id") -> Column:
    return F.substring(place(F.col(key)), 1, DIGITS)


def summaries(listed: DataFrame) -> dict[str, dict]:
    """What an entry says of every bucket; at most 16 ** DIGITS of them reach the driver."""
    counts = listed.groupBy(_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("documents"), F.sum("chunks").alias("chunks"), F.sum("words").alias("words"))
    digests = nodes(listed.select("document_id", "digest"), "document_id", (8, 4, DIGITS))[DIGITS]
    rows = counts.join(digests.select(F.col("prefix").alias("bucket"), "digest"), "bucket").collect()
    return {r.bucket: {"documents": r.documents, "chunks": r.chunks, "words": r.words, "digest": r.digest} for r in rows}


def root(buckets: dict[str, dict]) -> str:
    """The digest of a generation: its buckets' digests in order."""
    return hashlib.sha256("\n".join(f"{k}:{buckets[k]['digest']}" for k in sorted(buckets)).encode()).hexdigest()


def _aggregate(buckets: dict[str, dict]) -> dict[str, int]:
    return {k: sum(b[k] for b in buckets.values()) for k in ("documents", "chunks", "words")}


class Files:
    """Small files beside the data, by Hadoop's public file system interface: the one way to all stores that Spark reads, and to a create that fails if the file is there.

    On local disks a link takes the place of that create, which is exclusive on HDFS; on an object store it is as exclusive as its connector makes it.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def _at(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def create(self, path: str, text: str) -> bool:
        """Writes a file that is not there yet; whether it has."""
        from py4j.protocol import Py4JJavaError

        fs, target = self._at(path)
        if fs.getUri().getScheme() == "file":  # Hadoop looks there first and creates then; a link does both at once
            fs.mkdirs(target.getParent())
            place = fs.makeQualified(target).toUri().getPath()
            draft = f"{place}.{uuid.uuid4().hex}"
            with open(draft, "x", encoding="utf-8") as out:
                out.write(text)
            try:
                os.link(draft, place)
            except FileExistsError:
                return False
            finally:
                os.remove(draft)
            return True
        try:
            out = fs.create(target, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or fs.exists(target):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, path: str) -> str | None:
        """The one line of a file; None where it is missing."""
        fs, target = self._at(path)
        return "\n".join(r.value for r in self.spark.read.text(path).collect()) if fs.exists(target) else None

    def names(self, folder: str) -> list[str]:
        fs, target = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


class Corpus:
    """The generations of a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark)

    def head(self) -> int:
        """The number of the last generation; 0 where there is none."""
        names = [n for n in self.files.names(f"{self.folder}/log") if n.endswith(".json") and n[:-5].isdigit()]
        return int(names[-1][:-5]) if names else 0

    def _path(self, number: int) -> str:
        return f"{self.folder}/log/{number:010d}.json"

    def entry(self, number: int | None = None) -> dict:
        """An entry whose fields, number, aggregate, digest and parent are what they must be."""
        number = self.head() if number is None else number
        line = self.files.read(self._path(number)) if number else None
        if line is None:
            raise FileNotFoundError(f"{self.folder} holds no generation {number or ''}".rstrip())
        found = json.loads(line)
        if not isinstance(found, dict) or set(found) != ENTRY or any(set(b) - {"changes"} != BUCKET for b in found["buckets"].values()):
            raise ValueError("an entry of the log has missing or other fields")
        if found["version"] != VERSION:
            raise ValueError(f"version {found['version']} is not {VERSION}")
        if found["number"] != number:
            raise ValueError(f"entry {number} names itself {found['number']}")
        if found["aggregate"] != _aggregate(found["buckets"]):
            raise ValueError("the aggregate is not that of the listed buckets")
        if found["digest"] != root(found["buckets"]):
            raise ValueError("the digest is not that of the listed buckets")
        before = self.files.read(self._path(number - 1)) if number > 1 else ""
        if found["parent"] != hashlib.sha256((before or "").encode()).hexdigest():
            raise ValueError("the generation before is not the one that this one was made from")
        return found

    def _publish(self, action: str, chunks: DataFrame, buckets: dict[str, dict], whole: set[str], expected: int, removed: DataFrame | None = None) -> int:
        """Writes chunks, and the ids of removed, to a folder of their own and claims the number after expected.

        buckets are those of the generation before; of those of whole, chunks has all that stays. Chunks are read back and checked before.
        """
        chunks = chunks.select("document_id", "ordinal", "section", "text", "chunk_id")
        name = uuid.uuid4().hex
        folder = f"{self.folder}/data/{name}"
        # a bucket is written by several tasks, so that one long document does not make one long file
        parts = chunks.withColumn("bucket", _bucket()).repartition("bucket", F.pmod(F.floor(F.col("ordinal") / 4096), F.lit(8)))
        parts.write.mode("errorifexists").partitionBy("bucket").options(**PACKED).json(f"{folder}/chunks")
        told, at = stored(facts(self._json(CHUNK_SCHEMA, [f"{folder}/chunks"])), "facts")
        if (bad := record_faults(told).first()) is not None:
            raise ValueError(f"{bad.fault}: {bad.document_id} {bad.ordinal}")
        new = listing(told)
        if removed is not None:
            none = F.lit(0).cast("bigint")
            new = new.unionByName(removed.select("document_id", F.lit(None).cast("string").alias("digest"), none.alias("chunks"), none.alias("words")))
        new.withColumn("bucket", _bucket()).repartition("bucket").write.partitionBy("bucket").options(**PACKED).json(f"{folder}/listed")
        discard(at)
        touched = {n.removeprefix("bucket=") for n in self.files.names(f"{folder}/listed") if n.startswith("bucket=")}
        after = {k: b for k, b in buckets.items() if k not in touched | whole}
        for k in touched:
            more = k in buckets and k not in whole
            after[k] = {"folder": buckets[k]["folder"], "changes": [*buckets[k].get("changes", []), [name, action]]} if more else {"folder": name}
        live, at = stored(self._live({k: after[k] for k in touched}), "live")
        own = summaries(live)
        discard(at)
        after = {k: b | own.get(k, {}) for k, b in after.items() if k not in touched or k in own}
        before = self.files.read(self._path(expected)) if expected else ""
        entry = {"version": VERSION, "number": expected + 1, "parent": hashlib.sha256((before or "").encode()).hexdigest(), "action": action, "aggregate": _aggregate(after), "buckets": after, "digest": root(after)}
        if not self.files.create(self._path(expected + 1), json.dumps(entry, sort_keys=True)):
            raise ConcurrentUpdate(f"generation {expected + 1} has been published meanwhile")
        return expected + 1

    def _json(self, schema: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("mode", "FAILFAST").json(paths)

    def _files(self, buckets: dict[str, dict]) -> list[tuple[str, str, int, str]]:
        """(folder, bucket, nth, action): what makes up these buckets, the later the larger nth."""
        return [(f, k, n, a) for k, b in sorted(buckets.items()) for n, (f, a) in enumerate([(b["folder"], "replace"), *b.get("changes", [])])]

    def _order(self, buckets: dict[str, dict]) -> DataFrame:
        """_files() as a table; at most 16 ** DIGITS * (CHANGES + 1) rows."""
        return F.broadcast(self.spark.createDataFrame([x[:3] for x in self._files(buckets)], "folder string, bucket string, nth int"))

    def _read(self, kind: str, files: set[tuple[str, str]]) -> DataFrame:
        """The chunks or lists of (folder, bucket) files, with folder and bucket beside."""
        rows = self._json(CHUNK_SCHEMA if kind == "chunks" else LISTED_SCHEMA, [f"{self.folder}/data/{f}/{kind}/bucket={k}" for f, k in sorted(files)])
        upto = lambda n: F.substring_index(F.substring_index(F.input_file_name(), "/", n), "/", 1)
        return rows.select(upto(-4).alias("folder"), F.substring_index(upto(-2), "=", -1).alias("bucket"), *rows.columns)

    def _chunks(self, buckets: dict[str, dict]) -> DataFrame:
        """All chunks of these buckets, with those that later changes put or removed."""
        return self._read("chunks", {(f, k) for f, k, _, a in self._files(buckets) if a != "remove"})

    def _lists(self, buckets: dict[str, dict]) -> DataFrame:
        """All lists of these buckets; last tells whether no later one names the document. A removed document has no digest and no chunks."""
        rows = self._read("listed", {(f, k) for f, k, *_ in self._files(buckets)}).join(self._order(buckets), ["folder", "bucket"])
        return rows.withColumn("last", F.col("nth") == F.max("nth").over(Window.partitionBy("document_id"))).drop("nth")

    def _live(self, buckets: dict[str, dict]) -> DataFrame:
        """(folder, bucket, document_id, digest, chunks, words): the documents of these buckets as they are listed last."""
        return self._lists(buckets).where("last AND (digest IS NOT NULL OR chunks > 0)").drop("last")

    def _content(self, buckets: dict[str, dict]) -> DataFrame:
        """The chunks of these buckets that hold."""
        rows = self._chunks(buckets)
        if any("changes" in b for b in buckets.values()):
            rows = rows.join(self._lists(buckets).where("NOT last").select("folder", "bucket", "document_id"), ["folder", "bucket", "document_id"], "left_anti")
        return rows.drop("folder", "bucket")

    def _worn(self, ids: DataFrame, buckets: dict[str, dict]) -> dict[str, dict]:
        """The buckets of ids that have been changed CHANGES times."""
        worn = {k: b for k, b in buckets.items() if len(b.get("changes", [])) >= CHANGES}
        names = {r.bucket for r in ids.select(_bucket().alias("bucket")).distinct().collect()} if worn else set()
        return {k: b for k, b in worn.items() if k in names}

    def replace(self, chunks: DataFrame, expected: int | None = None) -> int:
        """A generation of chunks alone; its number. expected is the generation that it follows (the last one where it is None)."""
        return self._publish("replace", chunks, {}, set(), self.head() if expected is None else expected)

    def put(self, chunks: DataFrame, expected: int | None = None) -> int:
        """The generation before with the documents of chunks in place of theirs, or new."""
        expected = self.head() if expected is None else expected
        buckets = self.entry(expected)["buckets"] if expected else {}
        worn = self._worn(chunks, buckets)
        rows = chunks.select("document_id", "ordinal", "section", "text", "chunk_id")
        if worn:
            rows = self._content(worn).join(rows.select("document_id").distinct(), "document_id", "left_anti").unionByName(rows)
        return self._publish("put", rows, buckets, set(worn), expected)

    def remove(self, ids: DataFrame, expected: int | None = None) -> int:
        """The generation before without the documents of ids(document_id); an id that it has not is an error."""
        expected = self.head() if expected is None else expected
        buckets = self.entry(expected)["buckets"]
        ids = ids.select("document_id").distinct()
        missing = ids.join(self._live(buckets), "document_id", "left_anti").first()
        if missing is not None:
            raise KeyError(missing.document_id)
        worn = self._worn(ids, buckets)
        rest = self._content(worn).join(ids, "document_id", "left_anti") if worn else self._json(CHUNK_SCHEMA, [])
        return self._publish("remove", rest, buckets, set(worn), expected, ids.where(~_bucket().isin(sorted(worn))))

    def seen(self, numbers: list[int]) -> tuple[DataFrame, DataFrame, list[str]]:
        """What the files of these generations hold, each read once: facts() and listing(), with folder and bucket, as tables, and the tables' paths."""
        files = {(f, k) for n in numbers for f, k, _, a in self._files(self.entry(n)["buckets"]) if a != "remove"}
        told, at = stored(facts(self._read("chunks", files), "folder", "bucket"), "facts")
        found, lists = stored(listing(told, "folder", "bucket"), "listing")
        return told, found, [at, lists]

    def faults(self, number: int | None = None, seen: tuple[DataFrame, DataFrame, list[str]] | None = None) -> DataFrame:
        """(fault, document_id, ordinal): all that the files of a generation have against its entry; no row if they hold.

        identity, repeated id, repeated place: of records. unlisted, missing: documents in the chunks alone or in the list alone. chunks, words,
        digest: documents of which the list says otherwise. place: documents in a bucket that is not theirs. bucket: buckets (named in document_id) of which the entry says otherwise.
        What a later change has replaced or removed is no part of a generation. seen is what seen() found in its files; without it they are read.
        """
        number = self.head() if number is None else number
        buckets = self.entry(number)["buckets"]
        told, found, _ = seen or self.seen([number])
        key = ["folder", "bucket", "document_id"]
        own = self._order(buckets).drop("nth")
        told, found = (x.join(own, ["folder", "bucket"], "left_semi") for x in (told, found))
        lists, _ = stored(self._lists(buckets).select(*key, "last", *[F.col(c).alias(f"l_{c}") for c in ("digest", "chunks", "words")]), "lists")
        both, _ = stored(lists.join(found, key, "full_outer").where("last IS NULL OR last"), "live")
        gone = F.col("l_digest").isNull() & F.col("digest").isNull()
        kind = F.when(gone, None).when(F.col("l_digest").isNull(), "unlisted").when(F.col("digest").isNull(), "missing").when(F.col("l_chunks") != F.col("chunks"), "chunks").when(F.col("l_words") != F.col("words"), "words").when(F.col("l_digest") != F.col("digest"), "digest")
        against = both.select(kind.alias("fault"), "document_id", F.lit(None).cast("int").alias("ordinal")).where("fault is not null")
        past = lists.where("NOT last").select(*key)
        held = told.join(past, key, "left_anti") if any("changes" in b for b in buckets.values()) else told
        astray = held.where(F.col("bucket") != _bucket()).select(F.lit("place").alias("fault"), "document_id", "ordinal")
        said = {k: {x: v for x, v in b.items() if x not in ("folder", "changes")} for k, b in buckets.items()}
        real = summaries(both.where("digest IS NOT NULL"))
        odd = sorted(k for k in {*said, *real} if said.get(k) != real.get(k))
        out = record_faults(held).unionByName(against).unionByName(astray)
        return out.unionByName(self.spark.createDataFrame([("bucket", k, None) for k in odd], "fault string, document_id string, ordinal int")) if odd else out

    def documents(self, number: int | None = None) -> DataFrame:
        """What a generation lists of its documents: document_id, digest, chunks, words."""
        return self._live(self.entry(number)["buckets"]).select("document_id", "digest", "chunks", "words")

    def read(self, number: int | None = None) -> DataFrame:
        """The chunks of a generation, the last one by default, once nothing speaks against them."""
        if (bad := self.faults(number).first()) is not None:
            raise ValueError(f"{bad.fault}: {bad.document_id} {bad.ordinal if bad.ordinal is not None else ''}".rstrip())
        return self._content(self.entry(number)["buckets"])


def save_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("vec_id", "label", "embedding").write.mode("errorifexists").parquet(path)


def load_vectors(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """Vectors whose ids are unique and whose values are finite, of one dimension and unit length."""
    rows = spark.read.parquet(path)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    good = (F.size("embedding") == dimension) & (F.abs(norm - 1) <= 1e-4 + 1e-5)
    n, ids, fine = rows.agg(F.count(F.lit(1)), F.countDistinct("vec_id"), F.count_if(good)).first()
    if not n == ids == fine:
        raise ValueError(f"of {n} vectors {ids} have ids of their own and {fine} are unit vectors of {dimension} dimensions")
    return rows


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored with the rows of new in place of those of the same key. Keys that new repeats are an error, found when it runs."""
    counted = new.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    checked = new.join(counted, key).withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("a key stands twice in the new rows"))).otherwise(F.lit(True))).where("_ok").drop("_n", "_ok")
    return stored.join(new.select(key), key, "left_anti").unionByName(checked.select(*stored.columns))
