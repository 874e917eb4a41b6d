"""Delta-maintained token totals by source, language and tokenizer version, with idempotent batch commits.

A batch of changes becomes signed deltas: an insert adds a document and its tokens, a delete takes both away, a revision adds the
difference of its counts, or moves document and tokens from one tokenizer version to another. Deltas are summed by key, written aside and moved
under the batch's id in one step: a batch is there whole or not at all, and committing it again changes nothing. Totals are sums of the stored
deltas, so they never read the documents again; `compact` sums many batches into a base, after which totals read the base and what came later.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("source", "lang", "tokenizer")
STORED = "source string, lang string, tokenizer string, documents long, tokens long"


def signed(changes: DataFrame, times_col: str | None = None) -> DataFrame:
    """Deltas by key from changes (op, source, lang, tokenizer, tokens, prior_tokens and, if there, prior_tokenizer).

    op: insert, delete or revise; another, or none, changes nothing. A revision whose prior_tokenizer is another than its tokenizer takes the document
    and its prior tokens from that version and adds both to this one; without one, or with a null or the same, it adds the difference. times_col: how often a row's
    change happens (null: never). Null keys are keys of their own. A null count is 0. Repeated rows are changes of their own; further columns are
    not read. Sums are combined before the shuffle, so a hot source costs no more.
    """
    op, times = F.col("op"), F.lit(1) if times_col is None else F.coalesce(F.col(times_col).cast("long"), F.lit(0))
    sign = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0)
    count, prior = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("tokens", "prior_tokens"))
    tokens: Column = F.when(op == "revise", count - prior).otherwise(sign * count)
    place = [F.col(c).cast("string").alias(c) for c in KEY]
    if "prior_tokenizer" in changes.columns:
        before, now = (F.col(c).cast("string") for c in ("prior_tokenizer", "tokenizer"))
        moves = F.coalesce(op == "revise", F.lit(False)) & before.isNotNull() & ~before.eqNullSafe(now)
        taken = F.struct(before.alias("tokenizer"), F.lit(-1).alias("documents"), (-prior).alias("tokens"))
        added = F.struct(now.alias("tokenizer"), F.lit(1).alias("documents"), count.alias("tokens"))
        alone = F.struct(now.alias("tokenizer"), sign.alias("documents"), tokens.alias("tokens"))
        rows = changes.select(*place[:2], times.alias("times"), F.explode(F.when(moves, F.array(taken, added)).otherwise(F.array(alone))).alias("d"))
        rows = rows.select("source", "lang", "d.*", "times")
    else:
        rows = changes.select(*place, sign.alias("documents"), tokens.alias("tokens"), times.alias("times"))
    return rows.groupBy(*KEY).agg(*(F.sum(F.col(c).cast("long") * F.col("times")).alias(c) for c in ("documents", "tokens")))


class TokenRollup:
    """The totals kept in one folder.

    Several writers may commit at once, also the same batch: each writes aside, and the move that comes first counts. Only one may compact.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), where

    def _exists(self, path: str) -> bool:
        files, where = self._at(path)
        return files.exists(where)

    def _delete(self, path: str) -> None:
        files, where = self._at(path)
        files.delete(where, True)

    def _batch(self, batch_id: str) -> str:
        if not batch_id or "/" in batch_id or batch_id.startswith((".", "_")):
            raise ValueError(f"no batch id: {batch_id!r}")
        return f"{self.folder}/deltas/batch={batch_id}"

    def committed(self, batch_id: str) -> bool:
        """Spark writes a job's _SUCCESS after all its files are in place, and the folder is moved after that."""
        return self._exists(f"{self._batch(batch_id)}/_SUCCESS")

    def _store(self, rows: DataFrame, path: str) -> bool:
        """Write aside, then move; false where another writer was first."""
        name = f"_new-{uuid.uuid4().hex}"
        aside = f"{self.folder}/{name}"
        rows.write.parquet(aside)
        if not self._exists(f"{path}/_SUCCESS"):
            self._delete(path)  # what a commit lost midway left
            files, parent = self._at(path.rpartition("/")[0])
            files.mkdirs(parent)
            if files.rename(self._at(aside)[1], self._at(path)[1]) and not self._exists(f"{path}/{name}"):
                return True
        for rest in (aside, f"{path}/{name}"):  # a move onto a folder that came meanwhile ends inside it
            self._delete(rest)
        return False

    def commit(self, batch_id: str, changes: DataFrame, times_col: str | None = None) -> bool:
        """Store a batch; false, and nothing done, where it is committed already."""
        return not self.committed(batch_id) and self._store(signed(changes, times_col), self._batch(batch_id))

    def _bases(self) -> dict[str, frozenset[str]]:
        """The compacted bases and the batches each holds."""
        files, where = self._at(f"{self.folder}/bases")
        names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
        whole = [f"{self.folder}/bases/{n}" for n in names if self._exists(f"{self.folder}/bases/{n}/batches/_SUCCESS")]
        return {b: frozenset(r.batch for r in self.spark.read.parquet(f"{b}/batches").collect()) for b in whole}

    def compact(self, batches: list[str]) -> int:
        """Sum the committed ones of these batches into one base and drop the bases within it; how many batches it holds.

        The base counts once the list of its batches stands, written after its rows. The deltas stay, as the marks of their commits.
        """
        held = sorted({b for b in batches if self.committed(b)})
        if not held or frozenset(held) in self._bases().values():
            return len(held)
        base = f"{self.folder}/bases/{uuid.uuid4().hex}"
        self.totals(held).coalesce(1).write.parquet(f"{base}/rows")
        self.spark.createDataFrame([(b,) for b in held], "batch string").coalesce(1).write.parquet(f"{base}/batches")
        for older, within in self._bases().items():
            if within < frozenset(held):
                self._delete(older)
        return len(held)

    def totals(self, batches: list[str]) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) over the committed ones of these batches; keys whose sums are all 0 are gone.

        The base that holds most of them, and no other batch, is read in their place.
        """
        asked = {b: None for b in batches if self.committed(b)}
        base, within = max(((b, w) for b, w in self._bases().items() if w <= asked.keys()), key=lambda x: len(x[1]), default=("", frozenset()))
        paths = [self._batch(b) for b in asked if b not in within] + [f"{base}/rows"] * bool(base)
        rows = self.spark.read.schema(STORED).parquet(*paths) if paths else self.spark.createDataFrame([], STORED)
        return rows.groupBy(*KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")
