"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A ledger is a folder of committed batches. A batch brings inserts, deletes and revised counts of documents; the ledger
looks up what each document counted before and writes two things: the document's new count, and the batch's deltas
(documents and tokens, signed) by source, language and version. Totals are the sum of all deltas, so they cost what was
changed, not what is there. The look-up reads the counts of ids between the batch's least and greatest one; files are
sorted by id, so that a batch of new ids reads next to nothing. Every `compact_every` batches all counts and deltas are
written anew as one, from which reading starts.

A batch's data are written to a folder of their own and take effect when a marker file with the batch's number is
created, which succeeds for one writer only: a writer who comes second starts again from the state that the first one
left. A batch that is sent again, or whose first try died half-way, takes effect once.

In a batch, the change with the greatest `at` counts for a document and version (then revise over insert over delete,
then the greatest count). An insert or a revision of a known document replaces its count, source and language; a delete
of an unknown one changes nothing. Null ids are one document; null sources and languages are groups of their own; a null
count is zero. Null texts have no tokens.
"""

from __future__ import annotations

import base64
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_STATE = "doc_id long, version string, source string, lang string, n_tokens long, alive boolean, seq long"
_DELTA = "source string, lang string, version string, n_docs long, n_tokens long"
_ENCODERS: dict[str, object] = {}


def _encoder(file: str):
    """One tiktoken encoder for each worker process."""
    if file not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[file] = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[file]


def count_tokens(docs: DataFrame, ranks_file: str) -> DataFrame:
    """docs without text, with n_tokens by the vocabulary in that file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks_file).encode_ordinary
        for batch in batches:
            counts = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column("text")]
            rest = [c for c in batch.schema.names if c not in ("text", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(counts, pa.int64())], names=[*rest, "n_tokens"])

    kept = [f for f in docs.schema.fields if f.name not in ("text", "n_tokens")]
    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens long"]))


class Ledger:
    """Committed batches below a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 16):
        self.spark, self.path, self.compact_every = spark, path.rstrip("/"), compact_every
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _fs(self):
        root = self._hadoop.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def _marked(self, kind: str) -> list[tuple[int, str]]:
        """(number, content) of the markers of that kind, in order."""
        fs, root = self._fs()
        names = sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []
        return [(int(n.split("-")[1]), self._read_text(n)) for n in names if n.startswith(kind + "-")]

    def _read_text(self, name: str) -> str:
        fs, _ = self._fs()
        path = self._hadoop.Path(f"{self.path}/{name}")
        for _ in range(50):  # a marker is visible for a moment before its one line is there
            stream = fs.open(path)
            line = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
            stream.close()
            if line.endswith("\n"):
                return line[:-1]
            time.sleep(0.1)
        raise RuntimeError(f"{name} was left unfinished: remove it, its batch did not take effect")

    def _mark(self, name: str, line: str) -> bool:
        """Create a marker; False if there is one already."""
        fs, _ = self._fs()
        try:
            out = fs.create(self._hadoop.Path(f"{self.path}/{name}"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(line.encode() + b"\n"))
        out.close()
        return True

    def batches(self) -> list[str]:
        """Ids of the committed batches, in order of commit."""
        return [bytes.fromhex(line.split()[0]).decode() for _, line in self._marked("batch")]

    def _folders(self) -> list[str]:
        """Folders whose rows make up all there is: the last compacted one and the batches after it."""
        full = self._marked("full")[-1:]
        after = full[0][0] if full else -1
        return [line for _, line in full] + [line.split()[1] for seq, line in self._marked("batch") if seq > after]

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{f}/{part}" for f in self._folders()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def state(self, ids: str = "true") -> DataFrame:
        """The last count of every document and version whose id meets that condition, deleted ones included (alive is false)."""
        last = self._read("state", _STATE).where(ids).groupBy("doc_id", "version").agg(F.max_by(F.struct("source", "lang", "n_tokens", "alive", "seq"), "seq").alias("s"))
        return last.select("doc_id", "version", "s.*")

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens of the groups that have documents."""
        sums = self._sums(self._read("delta", _DELTA))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")

    def _sums(self, deltas: DataFrame) -> DataFrame:
        return deltas.groupBy("source", "lang", "version").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit changes(doc_id, source, lang, version, op, n_tokens, at); False if the batch is there already."""
        rank = F.expr("CASE op WHEN 'delete' THEN 0 WHEN 'insert' THEN 1 WHEN 'revise' THEN 2 ELSE raise_error('op must be insert, delete or revise') END")
        one = changes.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "version").agg(
            F.max(F.struct(F.coalesce("at", F.lit(0)).cast("long").alias("at"), rank.alias("rank"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "source", "lang")).alias("c")
        )
        if batch_id in self.batches():
            return False
        asked = f"{self.path}/data-{uuid.uuid4().hex}"
        one.select("doc_id", "version", "c.*").write.parquet(asked)
        one = self.spark.read.schema("doc_id long, version string, at long, rank int, n_tokens long, source string, lang string").parquet(asked)
        fs, _ = self._fs()
        while True:
            done = self._marked("batch")
            if any(bytes.fromhex(line.split()[0]).decode() == batch_id for _, line in done):
                fs.delete(self._hadoop.Path(asked), True)
                return False
            seq, folder = len(done), f"data-{uuid.uuid4().hex}"
            self._prepare(one, seq, f"{self.path}/{folder}")
            if self._mark(f"batch-{seq:012d}", f"{batch_id.encode().hex()} {folder}"):
                break
            fs.delete(self._hadoop.Path(f"{self.path}/{folder}"), True)
        fs.delete(self._hadoop.Path(asked), True)
        if (seq + 1) % self.compact_every == 0:
            self.compact()
        return True

    def _prepare(self, one: DataFrame, seq: int, folder: str) -> None:
        """Write what a batch's changes, one row a document and version, make of the present state."""
        low, high = one.agg(F.min("doc_id"), F.max("doc_id")).first()
        ids = f"doc_id IS NULL OR doc_id BETWEEN {low} AND {high}" if low is not None else "doc_id IS NULL"
        both = one.alias("n").join(self.state(ids).alias("o"), F.expr("n.doc_id IS NOT DISTINCT FROM o.doc_id AND n.version IS NOT DISTINCT FROM o.version"), "left")
        both = both.selectExpr("n.doc_id", "n.version", "n.rank > 0 AS alive", "n.n_tokens", "n.source", "n.lang", "coalesce(o.alive, false) AS was", "o.n_tokens AS old_tokens", "o.source AS old_source", "o.lang AS old_lang")
        both = both.where("alive OR was")
        state = both.selectExpr("doc_id", "version", "IF(alive, source, old_source) AS source", "IF(alive, lang, old_lang) AS lang", "IF(alive, n_tokens, 0L) AS n_tokens", "alive", f"{seq}L AS seq", "was", "old_source", "old_lang", "old_tokens")
        state.repartitionByRange("doc_id", "version").sortWithinPartitions("doc_id", "version").write.parquet(f"{folder}/state")
        rows = self.spark.read.schema(_STATE + ", was boolean, old_source string, old_lang string, old_tokens long").parquet(f"{folder}/state")
        signed = rows.where("was").selectExpr("old_source AS source", "old_lang AS lang", "version", "-1L AS n_docs", "-old_tokens AS n_tokens")
        signed = signed.unionByName(rows.where("alive").selectExpr("source", "lang", "version", "1L AS n_docs", "n_tokens"))
        self._sums(signed).write.parquet(f"{folder}/delta")

    def compact(self) -> None:
        """Write all counts and deltas anew as one folder; later reads start there. Batches' folders stay, as a record."""
        done = self._marked("batch")
        if not done:
            return
        folder = f"data-{uuid.uuid4().hex}"
        self.state().select("doc_id", "version", "source", "lang", "n_tokens", "alive", "seq").repartitionByRange("doc_id", "version").sortWithinPartitions("doc_id", "version").write.parquet(f"{self.path}/{folder}/state")
        self._sums(self._read("delta", _DELTA)).write.parquet(f"{self.path}/{folder}/delta")
        if len(self._marked("batch")) == len(done):  # else another writer's batch came in between; the next one compacts
            self._mark(f"full-{done[-1][0]:012d}", folder)
