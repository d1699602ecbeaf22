"""Occurrences and record counts of every term, kept up to date by signed deltas.

A record is a document. ``per_document`` counts the terms of whole records, each place once however
often it was delivered; ``deltas`` turns records that are added (+1), deleted (-1) or changed (-1 of the
old, +1 of the new) into per-term changes of the occurrences and of the number of records; ``merge`` adds
them to the counts held as files partitioned by a hash of the term, reading and rewriting only the
partitions that are touched, and drops terms that reach zero. Only the added, changed and deleted records are
ever aggregated. The number of records is held as the records of the null term, which every document has.

Few places are delivered twice, so rows are not shuffled to find them. Deliveries are counted in digits of one number for
``PLACES`` places of a document, which combines before the shuffle; a bit filter over the places that have
more than one sends only their rows through an exact choice of the last delivery. All others are counted
where they are read. Where the places are too many for a filter, all rows take the exact way.

Hot terms and hot documents: each aggregation combines before the shuffle on a key that splits
them, (document, places), then (document, term), then term.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dokuma.llm._filters import MOST_ENTRIES, BitFilter
from dokuma.session import delete, materialise, scratch
from dokuma.sources.tables import table

RARE_DOCS = 2
COMMON_SHARE = 0.5
#: Terms of one bucket of the counts, about; twice as many double the number of buckets.
BUCKET_ROWS = 100_000
#: Places counted in one number, four bits each.
PLACES = 15
#: Versions that stay readable.
KEEP = 2
#: All white space of Unicode, which is cut off at the ends of a token.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TERM = ["token", "token_type"]


def _terms(rows: DataFrame) -> DataFrame:
    """Tokens without blanks at the ends and types in capitals; a row that is no term, being empty, null or of
    type SPACE, becomes the null term."""
    token, kind = F.btrim("token", F.lit(_BLANKS)), F.upper("token_type")
    is_term = (token != "") & kind.isNotNull() & (kind != "SPACE")
    return rows.withColumn("token", F.when(is_term, token)).withColumn("token_type", F.when(is_term, kind))


def place_runs(rows: DataFrame) -> DataFrame:
    """(doc_id, run, digits, n): the rows of each run of PLACES places of a document, in digits and in all; run is null
    for rows without a place, and digits where they run over."""
    digit = F.expr(f"shiftleft(1L, cast(4 * pmod(pos, {PLACES}) as int))")
    return rows.groupBy("doc_id", F.floor(F.col("pos") / PLACES).alias("run")).agg(F.try_sum(digit).alias("digits"), F.count("*").alias("n"))


def repeated_places(runs: DataFrame) -> DataFrame:
    """(entry): the hashes of all (doc_id, pos) that have more than one row, and of some that have one: where the digits
    of a number run over, all its places."""
    seen = [F.expr(f"shiftright(digits, {4 * i}) & 15L") for i in range(PLACES)]
    over = F.coalesce(reduce(lambda a, b: a + b, seen) != F.col("n"), F.lit(True))
    twos = int("e" * PLACES, 16)  # the bits that a digit of two or more has one of
    some = runs.filter(F.col("run").isNotNull() & (over | (F.col("digits").bitwiseAND(twos) != 0)))
    listed = some.select("doc_id", "run", F.posexplode(F.array(*[over | (d > 1) for d in seen])).alias("i", "repeated")).filter("repeated")
    return listed.select(F.xxhash64("doc_id", (F.col("run") * PLACES + F.col("i")).cast("int")).alias("entry"))


def per_document(rows: DataFrame, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """(doc_id, token, token_type, n): how often each term occurs in each document, and a row of the null term with n = 0
    for every document.

    rows: doc_id, pos, token, token_type, loaded_at. Of the rows of one (doc_id, pos) the latest counts, ties by the
    greater token and type. Rows without doc_id are no record; rows without pos are told apart by load
    time, token and type. Other columns are ignored; an empty table gives no rows.
    """
    rows = rows.filter("doc_id is not null").select("doc_id", F.col("pos").cast("int").alias("pos"), "token", "token_type", "loaded_at")
    runs = materialise(place_runs(rows), "place-runs")
    filt = BitFilter(materialise(repeated_places(runs), "repeated-places"), most_entries)
    flagged = filt.flag(rows, F.xxhash64("doc_id", "pos")).withColumn("maybe", F.col("maybe") | F.col("pos").isNull())
    own = [F.when(F.col("pos").isNull(), F.col(c)).alias(f"own_{c}") for c in ("loaded_at", "token", "token_type")]
    last = flagged.filter("maybe").groupBy("doc_id", "pos", *own).agg(F.max(F.struct("loaded_at", "token", "token_type")).alias("r"))
    some = _terms(last.select("doc_id", "r.token", "r.token_type")).unionByName(_terms(flagged.filter("not maybe").select("doc_id", *TERM)))
    counted = some.filter("token is not null").withColumn("n", F.lit(1)).unionByName(runs.select("doc_id", F.lit(None).cast("string").alias("token"), F.lit(None).cast("string").alias("token_type"), F.lit(0).alias("n")))
    return counted.groupBy("doc_id", *TERM).agg(F.sum("n").alias("n"))


def deltas(counts: DataFrame, sign: int = 1, *by: str) -> DataFrame:
    """(by, token, token_type, occurrences, records): signed changes by whole records given as ``per_document`` does,
    for each value of the columns ``by``."""
    return counts.groupBy(*by, *TERM).agg((F.sum("n") * sign).alias("occurrences"), (F.count("*") * sign).alias("records"))


class TermCounts:
    """Counts kept under ``path``: terms in hash buckets, and a manifest of each version that says in which
    version's folder every bucket lies.

    A merge reads and rewrites only the buckets that its terms fall into; their number follows the number of
    terms, so a bucket holds about ``bucket_rows``. The manifest is written last, so a job that dies leaves the
    last version whole; folders that no version of the last KEEP needs are deleted. Opening a path that
    holds counts goes on from its last version.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.bucket_rows = spark, bucket_rows
        self.path = path or scratch(spark, "terms")
        self.version, self.buckets = 0, 1
        #: bucket -> (version it lies in, its terms)
        self.at: dict[int, tuple[int, int]] = {}
        self.needed: dict[int, set[tuple[int, int]]] = {}
        if path:
            self._open()

    def _files(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _versions(self) -> list[int]:
        """The versions whose manifest is whole."""
        fs, where = self._files()
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(path(f"{self.path}/{n}/manifest/_SUCCESS")))

    def _open(self) -> None:
        for version in self._versions()[-KEEP:]:
            rows = self.spark.read.schema("bucket int, at int, terms bigint, buckets int").parquet(f"{self.path}/v{version}/manifest").collect()  # a row a bucket
            self.version, self.buckets = version, max((r.buckets for r in rows), default=1)
            self.at = {r.bucket: (r.at, r.terms) for r in rows if r.bucket >= 0}
            self.needed[version] = {(b, v) for b, (v, _) in self.at.items()}

    def terms(self, only: list[int] | None = None) -> DataFrame:
        """(token, token_type, occurrences, records) of all buckets or of some, the null term among them."""
        schema = "token string, token_type string, occurrences bigint, records bigint"
        paths = [f"{self.path}/v{self.at[b][0]}/terms/bucket={b}" for b in (self.at if only is None else only) if b in self.at]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*TERM), F.lit(buckets)).cast("int").alias("bucket")

    def records(self) -> int:
        """The number of records, read from the bucket of the null term."""
        at = self.spark.range(1).select(F.lit(None).cast("string").alias("token"), F.lit(None).cast("string").alias("token_type")).select(self._bucket(self.buckets)).first().bucket
        row = self.terms([at]).filter("token is null").first()
        return row.records if row else 0

    def merge(self, added: DataFrame | None = None, deleted: DataFrame | None = None) -> TermCounts:
        """Bring in added and take out deleted records, both as ``per_document`` counts them. A changed
        record is given in both: its old counts as deleted, its new ones as added."""
        parts = [deltas(d, s) for d, s in ((added, 1), (deleted, -1)) if d is not None]
        return self.merge_deltas(reduce(DataFrame.unionByName, parts)) if parts else self

    def merge_deltas(self, changes: DataFrame) -> TermCounts:
        """Add signed changes (token, token_type, occurrences, records)."""
        sums = [F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")]
        delta = materialise(changes.groupBy(*TERM).agg(*sums), "term-deltas")
        held, buckets = sum(n for _, n in self.at.values()), self.buckets
        most = held + delta.count()
        while most > 2 * self.bucket_rows * buckets:
            buckets *= 2
        if buckets != self.buckets:  # the terms part anew
            touched, kept = list(self.at), {}
        else:
            touched = [r.bucket for r in delta.select(self._bucket(buckets)).distinct().collect()]  # one row a bucket
            kept = {b: v for b, v in self.at.items() if b not in touched}
        version, to = self.version + 1, f"{self.path}/v{self.version + 1}"
        # one shuffle by bucket serves the sums and the files: a bucket is one task's and one file
        both = self.terms(touched).unionByName(delta).withColumn("bucket", self._bucket(buckets)).repartition(min(max(len(touched), 1) if kept else buckets, 2000), "bucket")
        now = both.groupBy("bucket", *TERM).agg(*sums).filter("occurrences <> 0 or records <> 0")
        now.write.partitionBy("bucket").parquet(f"{to}/terms")
        sizes = self.spark.read.schema("token string, bucket int").parquet(f"{to}/terms").groupBy("bucket").agg(F.count("*").alias("n")).collect()
        at = kept | {r.bucket: (version, r.n) for r in sizes}
        rows = [(b, v, n, buckets) for b, (v, n) in at.items()] or [(-1, 0, 0, buckets)]
        self.spark.createDataFrame(rows, "bucket int, at int, terms bigint, buckets int").coalesce(1).write.parquet(f"{to}/manifest")
        self.version, self.at, self.buckets = version, at, buckets
        self.needed[version] = {(b, v) for b, (v, _) in at.items()}
        self._clear()
        return self

    def _clear(self) -> None:
        """Delete what no kept version needs."""
        old = [v for v in sorted(self.needed) if v <= self.version - KEEP]
        now = set().union(*(own for v, own in self.needed.items() if v not in old))
        for v in old:
            for b, at in self.needed.pop(v) - now:
                delete(self.spark, f"{self.path}/v{at}/terms/bucket={b}")
            delete(self.spark, f"{self.path}/v{v}/manifest")

    def marked(self, rare: int = RARE_DOCS, common: float = COMMON_SHARE) -> DataFrame:
        """All terms with mark: 'rare' (at most ``rare`` records), 'common' (more than
        that share of the records) or null. A term that is both is rare."""
        n = self.records()
        mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * n, "common")
        return self.terms().filter("token is not null").withColumn("mark", mark)


def _parted(spark: SparkSession, folder: str, parts: int) -> list[DataFrame]:
    """The table's changes as those of so many loads, parted by document, from one aggregation."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part")
    counts = per_document(table(spark, folder, "token_rows")).withColumn("part", part)
    all_ = materialise(deltas(counts, 1, "part"), "parted-deltas")
    return [all_.filter(F.col("part") == k).drop("part") for k in range(parts)]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The table comes in two loads, so that the second is merged into counts that are there."""
    one, two = _parted(spark, folder, 2)
    return TermCounts(spark).merge_deltas(one).merge_deltas(two).marked().filter("mark is not null").select("token", "token_type", "mark")


def p4_terms(spark: SparkSession, folder: str) -> DataFrame:
    """All terms with both counts, after loads of adding, deleting and adding again."""
    one, two, three = _parted(spark, folder, 3)
    back = one.withColumn("occurrences", -F.col("occurrences")).withColumn("records", -F.col("records"))
    counts = TermCounts(spark).merge_deltas(one.unionByName(two)).merge_deltas(three).merge_deltas(back).merge_deltas(one)
    return counts.marked().select("token", "token_type", "occurrences", "records", "mark")
