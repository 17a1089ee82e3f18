"""Quality rules as a bitmask ledger, in DataFrame functions alone.

Every rule is evaluated once for each document. The ledger keeps the measurements and one integer whose bit k says that
rule k failed; a policy is a mask of the bits that reject, so that policies can be versioned, replayed and ablated on the
ledger without touching a text again.

Defined results: a null text is the empty one (no words: it fails `few_words`); rows repeat as they come; an empty table
gives an empty ledger; other columns of the input are ignored by `ledger` and kept by `keep`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, id_and_text

#: Words in a window of the repetition rule.
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_stutters")


@dataclass(frozen=True)
class Rule:
    """`failed` is SQL over the measurements; `bit` never changes once it has been written to a ledger."""

    bit: int
    name: str
    failed: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "long_words", "word_chars > 25 * n_words"),
    Rule(5, "repeated_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule(6, "shouting", "n_letters >= 20 AND 2 * n_upper > n_letters"),
    Rule(7, "stuttering", "10 * n_stutters > 3 * n_words"),
)

#: Policies by version. The first is the base alone; a newer version never changes an older one.
POLICIES = {1: ("few_words", "repeated_windows"), 2: tuple(r.name for r in RULES)}
LATEST = max(POLICIES)


def mask_of(names: tuple[str, ...]) -> int:
    known = {r.name: r.mask for r in RULES}
    return sum(known[n] for n in set(names))


def policy_mask(version: int = LATEST) -> int:
    return mask_of(POLICIES[version])


def _measured(rows: DataFrame) -> DataFrame:
    """Adds MEASURES. The steps are columns of their own so that each array is built once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = rows.select("*", F.array_remove(F.split(text, f"{SPACE}+"), "").alias("_words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    windows = F.when(
        F.size("_words") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))),
    )
    out = out.select("*", windows.alias("_windows"))
    # Only documents with some window twice go on: (hash, position) in order puts equal windows side by side.
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.select("*", F.when(twice, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted"))
    beside = lambda k, h: F.coalesce(F.get("_sorted", k)["h"] == h, F.lit(False))
    starts = F.transform("_sorted", lambda x, k: F.when(beside(k - 1, x["h"]) | beside(k + 1, x["h"]), x["i"]))
    out = out.select("*", F.sort_array(F.array_compact(starts)).alias("_starts"))
    covered = F.aggregate(
        F.transform("_starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", k + 1), p + WINDOW) - p)),
        F.lit(0),
        lambda a, x: a + x,
    )
    counted = lambda pattern: F.regexp_count(text, F.lit(pattern))
    measures = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        counted(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        counted("[A-Z]").cast("long").alias("n_upper"),
        counted("[A-Za-z]").cast("long").alias("n_letters"),
        F.size(F.filter("_words", lambda w, i: w == F.get("_words", i - 1))).cast("long").alias("n_stutters"),
    )
    # Each document generates its one ledger entry. A filter on the entry stays above a generator; pushed below, it would
    # repeat the expressions that build the arrays inside lambdas, once for each word.
    return out.select(*rows.columns, F.explode(F.array(measures)).alias("_entry")).select(*rows.columns, "_entry.*")


def _bits() -> Column:
    out = F.lit(0).cast("long")
    for r in RULES:
        out = out.bitwiseOR(F.when(F.expr(r.failed), F.lit(r.mask)).otherwise(F.lit(0)).cast("long"))
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits: one row for each input row, nothing shuffled."""
    return _measured(id_and_text(docs)).select("doc_id", *MEASURES, _bits().alias("fail_bits"))


def apply_policy(rows: DataFrame, version: int = LATEST) -> DataFrame:
    """Adds base_failed and kept to a ledger."""
    fails = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) != 0
    base = fails(policy_mask(1))
    return rows.withColumns({"base_failed": base, "kept": ~base & ~fails(policy_mask(version))})


def keep(docs: DataFrame, version: int = LATEST) -> DataFrame:
    """The rows of docs that the policy keeps, with all their columns; repeated rows stay repeated, an empty table stays empty."""
    rows = docs.select(F.struct("*").alias("_row"), docs["text"].alias("text"))
    judged = apply_policy(_measured(rows).select("_row", _bits().alias("fail_bits")), version)
    return judged.filter("kept").select("_row.*")


def ablation(rows: DataFrame, version: int = LATEST) -> DataFrame:
    """For each rule of a policy: documents failing it, documents failing it alone, and what is kept without it.

    The ledger is folded to its distinct masks first (at most 2 to the number of rules), so each rule costs nothing more.
    """
    mask = policy_mask(version)
    masks = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if r.mask & mask]
    has = lambda m: F.col("bits").bitwiseAND(F.lit(m).cast("long"))
    sums = [F.array(F.lit(r.name), *(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("string") for c in (has(r.mask) != 0, F.col("bits") == r.mask, has(mask & ~r.mask) == 0))) for r in rules]
    one = masks.agg(F.array(*sums).alias("all")).select(F.explode("all").alias("x"))
    return one.select(F.col("x")[0].alias("rule"), *(F.col("x")[k].cast("long").alias(n) for k, n in ((1, "n_failed"), (2, "n_failed_alone"), (3, "n_kept_without"))))


def shared_bits(rows: DataFrame, *by: Column | str) -> DataFrame:
    """Rules that every document, and that any document, of a group fails: bitwise aggregation of the ledger."""
    return rows.groupBy(*by).agg(F.bit_and("fail_bits").alias("all_fail"), F.bit_or("fail_bits").alias("any_fail"), F.count("*").alias("n_docs"))


def _oracle() -> str:
    bits = " | ".join(f"(CASE WHEN {r.failed} THEN {r.mask} ELSE 0 END)" for r in RULES)
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i+{WINDOW - 1}], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, range(0, {WINDOW}) r(j) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
         CAST(length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS BIGINT) AS n_letters,
         CAST(len(list_filter(words, lambda x, i: i > 1 AND words[i - 1] = x)) AS BIGINT) AS n_stutters
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
b AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
SELECT *, (fail_bits & {policy_mask(1)}) <> 0 AS base_failed, (fail_bits & {policy_mask()}) = 0 AS kept FROM b
"""


ORACLE_SQL = _oracle()
