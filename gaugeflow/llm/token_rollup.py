"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A batch of changes (``op`` insert, revise or delete) is turned into signed rows: what
its documents counted before leaves with a minus sign, in every tokenizer version that
counted them, what they count now enters with a plus sign. Sums of signed rows are the
totals, whatever the order of the batches, and no batch reads a text that it doesn't bring.

Layout: each attempt of a batch has a folder of its own, ``ledger`` with the signed rows
by document and ``totals`` with their sums; a commit (see ``CommitLog``) names the folder
and the batch. Folders that no commit names are never read, and a batch that has a commit
is not applied again, so a batch may be sent any number of times, also after a crash or by
two writers at once: the one that comes second reads the state anew. Every ``COMPACT``
batches the ledgers are summed up into one.

Texts are tokenized in the scan; only numbers are shuffled.

Defined cases: an insert of a known document is a revision, a revision of an unknown one
an insert, a delete of an unknown one nothing; an ``op`` that is null or any other word
counts as an insert; of several changes of one document in a batch the last by ``seq``
counts (a null one is the first), and of equal ``seq`` the greatest row; a null or empty
text has 0 tokens and counts as a document; null sources and languages are groups of
their own; rows without doc_id are counted one by one and can't be deleted or revised;
an empty batch commits and changes nothing; texts of any length are counted in pieces;
other columns are ignored.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import CommitLog, remove, settle, workdir
from .textkit import slices
from .tokens import BYTE_BPE, WORDS, ship, with_counts

GROUP = ["source", "lang", "tokenizer"]
COMPACT = 16


class TokenRollup:
    """Totals in ``path``. ``tokenizers`` maps a version's name to a vocabulary file, or
    to ``WORDS``."""

    def __init__(self, spark: SparkSession, tokenizers: dict[str, str], path: str | None = None):
        self.spark, self.tokenizers = spark, dict(tokenizers)
        self.path = path or workdir(spark, "token-rollup")
        self.log = CommitLog(spark, self.path)
        ship(spark, *self.tokenizers.values())

    def committed(self) -> list[str]:
        """The batches applied so far."""
        return [b for e in self.log.entries() for b in e["batches"]]

    def _read(self, entries: list[dict], part: str) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.path}/{e['at']}/{part}" for e in entries]) if entries else None

    def _counted(self, changes: DataFrame) -> DataFrame:
        names, files = list(self.tokenizers), list(self.tokenizers.values())

        def count(batches):
            for b in slices(batches):
                counts = with_counts(b, files)
                each = pa.StructArray.from_arrays(counts, names=[f"t{i}" for i in range(len(files))])
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["seq"], b["op"], b["source"], b["lang"], each], names=["doc_id", "seq", "op", "source", "lang", "n"])

        id_type = changes.schema["doc_id"].dataType.simpleString()
        fields = ",".join(f"t{i}:bigint" for i in range(len(names)))
        op = F.when(F.col("op") == "delete", F.col("op")).otherwise(F.lit("insert")).alias("op")
        text = F.when(F.col("op") == "delete", None).otherwise(F.col("text")).alias("text")
        seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
        return changes.select("doc_id", seq.alias("seq"), op, "source", "lang", text).mapInArrow(
            count, f"doc_id {id_type}, seq bigint, op string, source string, lang string, n struct<{fields}>"
        )

    def _signed(self, entries: list[dict], changes: DataFrame) -> DataFrame:
        # split before the texts are tokenized: a filter behind that would tokenize all twice
        named, nameless = self._counted(changes.where("doc_id IS NOT NULL")), self._counted(changes.where("doc_id IS NULL"))
        last = named.groupBy("doc_id").agg(F.max(F.struct("seq", "op", "source", "lang", "n")).alias("r")).select("doc_id", "r.*")
        live = last.unionByName(nameless).where("op <> 'delete'")
        versions = F.array(*[F.struct(F.lit(name).alias("tokenizer"), F.col(f"n.t{i}").alias("tokens")) for i, name in enumerate(self.tokenizers)])
        signed = live.select("doc_id", "source", "lang", F.lit(1).cast("long").alias("docs"), F.inline(versions)).select("doc_id", *GROUP, "docs", "tokens")
        ledger = self._read(entries, "ledger")
        if ledger is None:
            return signed
        ids = changes.where("doc_id IS NOT NULL").select("doc_id").distinct()
        held = ledger.join(ids, "doc_id", "left_semi").groupBy("doc_id", *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs > 0")
        return signed.unionByName(held.withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")}))

    def _sum(self, rows: DataFrame, *more: str) -> DataFrame:
        return rows.groupBy(*more, *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch (doc_id, op, text, source, lang, and seq if there may be several
        changes of a document). False if it had been committed before."""
        while True:
            entries = self.log.entries()
            if any(batch_id in e["batches"] for e in entries):
                return False
            at = uuid.uuid4().hex
            written = settle(self._signed(entries, changes), f"{self.path}/{at}/ledger")
            settle(self._sum(written), f"{self.path}/{at}/totals")
            if self.log.append(entries[-1]["number"] + 1 if entries else 1, {"batches": [batch_id], "at": at}):
                break
            remove(self.spark, f"{self.path}/{at}")
        if len(entries) >= COMPACT:
            self.compact()
        return True

    def compact(self) -> None:
        """Sum up all ledgers: a row per live document, group and version."""
        entries = self.log.entries()
        if not entries:
            return
        at = uuid.uuid4().hex
        # rows without doc_id add up to one row per group
        ledger = settle(self._sum(self._read(entries, "ledger"), "doc_id").where("docs <> 0"), f"{self.path}/{at}/ledger")
        settle(self._sum(ledger), f"{self.path}/{at}/totals")
        summed = {"base": True, "batches": [b for e in entries for b in e["batches"]], "at": at}
        old = entries if self.log.append(entries[-1]["number"] + 1, summed) else [summed]
        for e in old:
            remove(self.spark, f"{self.path}/{e['at']}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) of all live documents."""
        totals = self._read(self.log.entries(), "totals")
        if totals is None:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, docs bigint, tokens bigint")
        return self._sum(totals).where("docs <> 0")


def op1_token_rollup(spark: SparkSession, sf_dir: str, tokenizer_path: str = BYTE_BPE) -> DataFrame:
    """Totals of all documents after four batches: all are inserted, an eighth of them as a
    draft of another source; the drafts are revised and another eighth deleted; the deleted
    ones are inserted again; the second batch is sent once more, which changes nothing."""
    rollup = TokenRollup(spark, {"byte_bpe_50k": tokenizer_path, "words_v1": WORDS})
    docs, eighth = spark.read.parquet(f"{sf_dir}/documents.parquet"), F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(8)), F.lit(0))
    named = F.col("doc_id").isNotNull()
    draft, gone = named & (eighth == 1), named & (eighth == 2)
    first = docs.withColumns({"op": F.lit("insert"), "source": F.when(draft, "draft").otherwise(F.col("source")), "text": F.when(draft, F.concat(F.lit("draft "), "text")).otherwise(F.col("text"))})
    second = docs.where(draft | gone).withColumn("op", F.when(draft, "revise").otherwise("delete"))
    rollup.apply("all", first)
    rollup.apply("changes", second)
    rollup.apply("restored", docs.where(gone).withColumn("op", F.lit("insert")))
    rollup.apply("changes", second)
    return rollup.totals()
