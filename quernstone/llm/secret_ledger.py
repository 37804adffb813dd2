"""Secret scanning over an incremental blob ledger, with DataFrame functions only.

Every text is a version of a blob named by the SHA-256 of its content. The ledger is a Parquet table
with one row for each scanned (blob, rule version) and its findings. A run content-addresses all rows, takes one
row for each blob, drops those whose (blob, rule version) the ledger holds already, scans the rest, appends
them to the ledger, and joins findings back to every row with that content. Copies, however many, are scanned once;
a second run over a grown history scans only what is new; a changed rule has another version and is scanned again.

Positions come from marking: a rule's matches are wrapped in two noncharacters and the marked text is split at
them, so that the lengths of the parts give code point offsets.

Defined results: a null text is an empty one, without findings; repeated rows each get their content's
findings; an empty table leaves the ledger as it is; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.quality import let
from quernstone.llm.rowmap import bitmap_of, perhaps_in
from quernstone.llm.staging import fresh_dir, in_full
from quernstone.session import shuffles_freed

_OPEN, _MID, _CLOSE, _STAND_IN = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"


class Rule(NamedTuple):
    """``pattern`` has two groups: what comes before the value, and the value, which has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.kind}\0{self.pattern}\0{self.least}".encode()).hexdigest()[:16]


#: The base rules, in the order in which spans with one start are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6),
    Rule("access", r"()(AKIA[A-Z0-9]+)", 20),
    Rule("hex", r"()((?<![0-9a-f])[0-9a-f]{24,}+)", 24),
)
#: Further kinds; their spans come beside the base ones.
_GAP = r"(?:\s|\\n|\\r)"
_END = r"-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----"
#: A private key from its first line through header lines and the block of base64 to its last line, if it has one.
_PEM = rf"[A-Z0-9 ]{{0,40}}PRIVATE KEY-----(?:{_GAP}+[A-Za-z-]{{1,20}}: [A-Za-z0-9, -]{{1,200}}){{0,5}}(?:{_GAP}+[A-Za-z0-9+/=]{{40,}})*(?:{_GAP}+[A-Za-z0-9+/=]{{1,76}}{_GAP}*{_END}|{_GAP}*{_END})?"
MORE_RULES = (Rule("pem", rf"(-----BEGIN )({_PEM})", 16),)


def running(values: Column, step: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """Running results of ``step`` over an array<bigint>. Appending copies, so it is done by blocks: n * ``block`` copies and not n * n."""
    none = F.array().cast("array<bigint>")

    def over(part: Column, start: Column) -> Column:
        state = F.struct(start.alias("now"), none.alias("out"))
        return F.aggregate(part, state, lambda s, x: let(step(s["now"], x), lambda y: F.struct(y.alias("now"), F.array_append(s["out"], y).alias("out"))), lambda s: s["out"])

    def blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(v) - 1), F.lit(block))
        parts = F.transform(starts, lambda k: F.slice(v, k + 1, block))
        zero = F.lit(0).cast("bigint")
        sums = F.transform(parts, lambda p: F.aggregate(p, zero, step))
        before = lambda done: F.transform(parts, lambda p, k: over(p, F.when(k > 0, F.get(done, k - 1)).otherwise(zero)))
        return let(over(sums, zero), lambda done: F.flatten(before(done)))

    return let(values, blocks)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<begin, place, kind, finish>> of a rule's leftmost non-overlapping matches."""
    safe = F.translate(text, _OPEN + _MID + _CLOSE, _STAND_IN * 3)
    marked = F.regexp_replace(safe, F.lit(rule.pattern), F.lit(f"{_OPEN}$1{_MID}$2{_CLOSE}"))
    parts = F.split(marked, f"[{_OPEN}{_MID}{_CLOSE}]")  # outside, before, value, outside, before, value, ... outside
    lengths = F.transform(parts, lambda p: F.length(p).cast("bigint"))
    empty = F.array().cast("array<struct<begin:bigint,place:int,kind:string,finish:bigint>>")

    def found(n: Column, end: Column) -> Column:
        long_enough = F.filter(F.sequence(F.lit(2), F.size(n) - 1, F.lit(3)), lambda k: F.get(n, k) >= rule.least)
        return F.transform(long_enough, lambda k: F.struct(F.get(end, k - 2).alias("begin"), F.lit(order).alias("place"), F.lit(rule.kind).alias("kind"), F.get(end, k).alias("finish")))

    spans = let(lengths, lambda n: F.when(F.size(n) > 3, let(running(n, lambda a, x: a + x), lambda end: found(n, end))).otherwise(empty))
    return F.when(text.rlike(rule.pattern), spans).otherwise(empty)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["finish"])), ",")


LEDGER = "blob_id string, rule_version string, findings array<struct<begin:bigint,place:int,kind:string,finish:bigint>>"


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blobs(blob_id, text, missing)`` -> one ledger row for each blob and missing rule version."""
    each = F.array(*(F.struct(F.lit(r.version).alias("rule_version"), F.when(F.array_contains("missing", r.version), spans_of(F.col("text"), r, i)).alias("findings")) for i, r in enumerate(rules)))
    return blobs.select("blob_id", F.inline(each)).where("findings is not null")


def scan_versions(versions: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text: str = "text", version_id: str = "doc_id") -> DataFrame:
    """Bring the ledger up to date with ``versions``; ``<version_id>, findings`` (in order of start) for every row of it.

    ``ledger_path``: a Parquet table that grows from run to run; without it, one for this call alone.
    """
    spark = versions.sparkSession
    known_before = ledger_path is not None and _exists(spark, ledger_path)
    ledger_path = ledger_path or fresh_dir(spark, "ledger")
    current = [r.version for r in rules]
    rows = versions.select(F.col(version_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    address = rows.select("id", F.sha2("text", 256).alias("blob_id"))

    # One row stands for each blob; copies are dropped where they are before anything is sent.
    blobs = rows.select(F.sha2("text", 256).alias("blob_id"), "text").dropDuplicates(["blob_id"])
    every = F.array(*map(F.lit, current))
    if known_before:
        known = spark.read.schema(LEDGER).parquet(ledger_path).where(F.col("rule_version").isin(current)).groupBy("blob_id").agg(F.collect_set("rule_version").alias("known"))
        missing = F.array_except(every, F.coalesce("known", F.array().cast("array<string>")))
        unseen = blobs.join(known.hint("merge"), "blob_id", "left").select("blob_id", "text", missing.alias("missing")).where("size(missing) > 0")
    else:
        unseen = blobs.withColumn("missing", every)
    with shuffles_freed(spark):
        scan(unseen, rules).write.mode("append").parquet(ledger_path)

    ledger = spark.read.schema(LEDGER).parquet(ledger_path).where(F.col("rule_version").isin(current) & (F.size("findings") > 0))
    found = ledger.groupBy("blob_id").agg(F.array_sort(F.flatten(F.collect_list("findings"))).alias("findings"))
    empty = F.array().cast("array<struct<begin:bigint,place:int,kind:string,finish:bigint>>")
    return address.join(found, "blob_id", "left").select(F.col("id").alias(version_id), F.coalesce("findings", empty).alias("findings"))


def _exists(spark, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def digest(found: DataFrame) -> DataFrame:
    """Counts of base kinds, the digest of base spans, and all spans, from ``doc_id, findings``."""
    base = F.filter("findings", lambda s: s["place"] < len(BASE_RULES))
    number = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret value replaced by ``mark``, through the same ledger; ``n_chars`` is brought up to date.

    Rows are joined to findings by content, so repeated ids with different texts are handled.
    """
    columns = docs.columns
    text_id = F.sha2(F.coalesce("text", F.lit("")), 256)

    def to_mask() -> DataFrame:
        found = scan_versions(docs.select("text", text_id.alias("content")).dropDuplicates(["content"]), rules=rules, version_id="content")
        return found.where(F.size("findings") > 0)

    found = in_full(docs.sparkSession, "to-mask", to_mask)
    text = F.col("text")

    def cut(spans: Column, ends: Column) -> Column:
        """What stands between masked runs, each followed by the mark; overlapping findings are one run."""
        before = lambda k: F.coalesce(F.get(ends, k - 1), F.lit(0).cast("bigint"))
        first = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda k: (k == 0) | (F.get(spans, k)["begin"] >= before(k)))
        pieces = F.transform(first, lambda k: F.concat(F.substring(text, (before(k) + 1).cast("int"), (F.get(spans, k)["begin"] - before(k)).cast("int")), F.lit(mark)))
        return F.concat(F.array_join(pieces, ""), F.substring(text, (F.element_at(ends, -1) + 1).cast("int"), F.length(text)))

    finish = running(F.transform("findings", lambda x: x["finish"]), lambda a, x: F.greatest(a, x))
    clean = F.when(F.col("findings").isNull(), text).otherwise(let(finish, lambda ends: cut(F.col("findings"), ends)))
    # Whole rows travel as one column, since a table's other columns may have any names.
    rows = docs.select("text", text_id.alias("content"), F.struct(*columns).alias("document"))
    told = perhaps_in(rows, bitmap_of(found, "content"), "content")
    plain = told.where("not perhaps").select("document", text.alias("masked"))
    masked = plain.unionByName(told.where("perhaps").join(found.hint("merge"), "content", "left").select("document", clean.alias("masked")))
    new = {"text": F.col("masked"), "n_chars": F.length("masked").cast("long")}
    return masked.select(*(new.get(c, F.col("document").getField(c)).alias(c) for c in columns))


def _oracle() -> str:
    base = {
        "assign": r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""".replace("\\\\", "\\"),
        "access": r"(AKIA[A-Z0-9]+)",
        "hex": r"([0-9a-f]+)",
        "pem": f"-----BEGIN ({_PEM})",
    }
    least = {r.kind: r.least for r in BASE_RULES + MORE_RULES}
    found, spans = [], []
    for i, (kind, pattern) in enumerate(base.items()):
        found.append(f"regexp_extract_all(t, '{pattern}') AS m{i}, regexp_split_to_array(t, '{pattern}') AS o{i}, list_transform(m{i}, lambda x: length(regexp_extract(x, '{pattern}', 1))) AS v{i}")
        spans.append(f"list_filter(list_transform(range(1, len(m{i}) + 1), lambda k: {{'b': list_sum(list_transform(o{i}[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m{i}[1:k - 1], lambda x: length(x))), 0), 'p': {i}, 'k': '{kind}', 'n': length(m{i}[k]), 'v': v{i}[k]}}), lambda z: z.v >= {least[kind]})")
    text = "list_transform({}, lambda z: z.k || ':' || CAST(z.b AS BIGINT) || ':' || CAST(z.b + z.n AS BIGINT))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {", ".join(found)} FROM d),
s AS (SELECT doc_id, list_sort(list_concat(list_concat({spans[0]}, {spans[1]}), list_concat({spans[2]}, {spans[3]}))) AS sp FROM f)
SELECT doc_id, len(list_filter(sp, lambda x: x.p = 0)) AS n_assign, len(list_filter(sp, lambda x: x.p = 1)) AS n_access, len(list_filter(sp, lambda x: x.p = 2)) AS n_hex,
       sha256(coalesce(array_to_string({text.format("list_filter(sp, lambda x: x.p < 3)")}, ','), '')) AS base_sha256,
       coalesce(array_to_string({text.format("sp")}, ','), '') AS spans
FROM s"""


ORACLE = _oracle()
