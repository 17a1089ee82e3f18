"""Review of pairs: names, selections, reasons against approval, validations, lookups, contexts and pages."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.registry import PAIR
from tidemark.sources.soaks import content

#: Statuses that may be recorded, equivalences that may be approved, scopes that only test connections,
#: labels of regions in tickers, verdicts of audits, and the keywords of resolution structures from the most doubtful on.
SCANNABLE = ("approved_for_paper",)
APPROVABLE = ("verified_equivalent", "tail_divergence_documented")
CONNECTIVITY = ("connectivity_only", "connectivity-only")
REGIONS = {"AFR": "Africa (CAF)", "EUR": "Europe (UEFA)", "NA": "North America (CONCACAF)", "SA": "South America (CONMEBOL)"}
VERDICTS = ("basis", "tail_divergence_documented", "unreviewed", "verified_equivalent")
MAX_CUTOFF_HOURS, LONG_DAYS = 1.0, 90.0


def load(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The pairs of a registry document (JSON, or YAML where a parser is there) whose recorded SHA-256 must match.

    A registry is a small document that the driver reads, from any path that Spark reads; a missing or other digest is an error.
    """
    raw = content(spark, path)
    if raw is None:
        raise FileNotFoundError(path)
    if verify:
        known = (content(spark, path + ".sha256") or b"").decode().split()[:1]
        if known != [hashlib.sha256(raw).hexdigest()]:
            raise ValueError(f"integrity check failed: {path}")
    try:
        document = json.loads(raw)
    except ValueError:
        import yaml

        document = yaml.safe_load(raw)
    rows = []
    for p in document["pairs"]:
        ids = p.get("b_identifiers") or {}
        rows.append((p.get("pair_key"), p.get("a_market"), ids.get("token"), ids.get("condition"), p.get("b_market"), p.get("include"), p.get("status"), [(d.get("at"), d.get("decision")) for d in p.get("decisions") or []]))
    return spark.createDataFrame(rows, PAIR)


def scannable(pairs: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """Pairs whose status may be recorded, of the requested keys if some are given; unknown keys are an error."""
    rows = pairs.filter(F.col("status").isin(*SCANNABLE))
    if not requested:
        return rows
    wanted = pairs.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(requested)], "pair_key string")
    unknown = [r[0] for r in wanted.join(rows, "pair_key", "left_anti").orderBy("pair_key").collect()]  # of the few that were asked for
    if unknown:
        raise ValueError(f"unknown pairs: {', '.join(unknown)}")
    return rows.join(wanted, "pair_key", "left_semi")


def naming(pairs: DataFrame, needle: str) -> DataFrame:
    return pairs.filter(F.col("pair_key").contains(needle))


def block_reason() -> Column:
    """Why a pair may not be approved, null if it may; columns equivalence, contract_equivalent and scope."""
    return (
        F.when(~F.coalesce(F.col("equivalence").isin(*APPROVABLE), F.lit(False)), "equivalence_not_verified")
        .when(F.coalesce(~F.col("contract_equivalent"), F.lit(False)), "contracts_not_equivalent").when(F.lower(F.trim("scope")).isin(*CONNECTIVITY), "connectivity_only")
    )


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def _flagged(rows: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    """(pair_key, violation) for each check that holds, and for keys that come again."""
    again = F.count("*").over(Window.partitionBy("pair_key")) > 1
    all_checks = [*checks, (F.col("_again"), "duplicate_pair_key")]
    flags = F.array_compact(F.array(*(F.when(F.coalesce(when, F.lit(False)), name) for when, name in all_checks)))
    return rows.withColumn("_again", again).select("pair_key", F.explode(flags).alias("violation"))


def registry_violations(pairs: DataFrame) -> DataFrame:
    """What is wrong with approved pairs: pair_key, a_market, b_market, orientation, status, human_approved, reviewer,
    reviewer_notes, approved_at, contract_equivalent, scope, include."""
    other = F.coalesce(~F.col("contract_equivalent"), F.lit(False))
    return _flagged(pairs, [
        (_blank("pair_key"), "missing_pair_key"), (_blank("a_market"), "missing_a_market"), (_blank("b_market"), "missing_b_market"),
        (~F.coalesce(F.col("orientation").isin("same", "inverted"), F.lit(False)), "orientation"), (F.coalesce(F.col("status"), F.lit("")) != "approved_for_paper", "status"),
        (~F.coalesce(F.col("human_approved"), F.lit(False)), "not_human_approved"), (other & (F.coalesce(F.col("scope"), F.lit("")) != "connectivity_only"), "scope_of_other_contracts"),
        (other & F.coalesce(F.col("include"), F.lit(True)), "other_contracts_in_metrics"), (_blank("reviewer"), "missing_reviewer"), (F.length(F.trim(F.coalesce("reviewer_notes", F.lit("")))) < 20, "short_notes"),
        (F.try_to_timestamp("approved_at").isNull(), "approved_at"),
    ])


def candidate_violations(candidates: DataFrame) -> DataFrame:
    """What is wrong with queued candidates: texts, orientation, status, auto_approved, confidence (text)."""
    texts = [(_blank(c), f"missing_{c}") for c in ("pair_key", "a_market", "b_market", "a_question", "b_question", "a_close_time", "b_close_time")]
    x = F.col("confidence").try_cast("double")
    return _flagged(candidates, [
        *texts, (~F.coalesce(F.col("orientation").isin("same", "inverted"), F.lit(False)), "orientation"), (F.coalesce(F.col("status"), F.lit("")) != "candidate", "status"),
        (F.coalesce(F.col("auto_approved"), F.lit(True)), "auto_approved"), (x.isNull(), "confidence_not_numeric"), ((x < 0) | (x > 1), "confidence_out_of_range"),
    ])


def verdict(rows: DataFrame, text: str) -> DataFrame:
    """Adds verdict (of the last fenced JSON block) and problem, null if the verdict can be used."""
    blocks = F.regexp_extract_all(F.col(text), F.lit(r"(?s)```json\s*(\{.*?\})\s*```"), F.lit(1))
    parsed = F.from_json(F.try_element_at(blocks, F.lit(-1)), "status string, tail_risks array<string>, confidence double, grouping_check string, date_check string")
    rows = rows.withColumn("_n", F.size(blocks)).withColumn("verdict", parsed)
    v = lambda c: F.col(f"verdict.{c}")
    missing = lambda c: F.trim(F.coalesce(v(c), F.lit(""))) == ""
    problem = (
        F.when(F.col("_n") == 0, "no_block").when(~F.coalesce(v("status").isin(*VERDICTS), F.lit(False)), "status").when(v("tail_risks").isNull(), "tail_risks")
        .when(v("confidence").isNull() | (v("confidence") < 0) | (v("confidence") > 1), "confidence").when(missing("grouping_check") | missing("date_check"), "checks")
    )
    return rows.withColumn("problem", problem).drop("_n")


def structure(text: Column, subjective: tuple[str, ...], grouping: tuple[str, ...], dated: tuple[str, ...]) -> Column:
    """Resolution structure by keywords, the most doubtful first; texts without words need a reader."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda words: reduce(lambda a, w: a | low.contains(w), words, F.lit(False))
    return F.when(F.trim(low) == "", "needs_human").when(has(subjective), "subjective").when(has(grouping), "categorical_grouping").when(has(dated), "date_cutoff").otherwise("objective_single_event")


def prescreened(rows: DataFrame, now: Column) -> DataFrame:
    """Adds flags in order: structure (text column), cutoff distance, duration, and the snapshot's warnings."""
    hours = (F.unix_micros("a_close_time") - F.unix_micros("b_close_time")) / 3.6e9
    days = (F.unix_micros("a_close_time") - F.unix_micros(now)) / 8.64e10
    own = F.array(
        F.when(F.col("structure") == "subjective", "subjective").when(F.col("structure") == "needs_human", "no_rules"),
        F.when(hours.isNull(), "cutoff_unknown").when(F.abs(hours) > MAX_CUTOFF_HOURS, "cutoff_differs"), F.when(days > LONG_DAYS, "long_dated"),
    )
    return rows.withColumn("flags", F.concat(F.array_compact(own), F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.concat(F.lit("snapshot: "), w))))


def display_name(existing: Column, question: Column, ticker: Column, key: Column) -> Column:
    """A label: the one that is there, else from the question, from the ticker's family, or the key itself."""
    some = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    q = F.regexp_replace(F.trim(F.regexp_replace(F.replace(question, F.lit("—"), F.lit("-")), r"\s+", " ")), r"^$", "")
    part = lambda pattern, k: F.regexp_extract(q, pattern, k)
    nominee, cup, race = (rf"^Will (.+?) {x}" for x in (r"be the Democratic Presidential nominee in (\d{4})\?", r"win the (\d{4}) (?:Men's |FIFA )?World Cup\?", r"win the F1 Drivers Championship\?"))
    of_question = (
        F.when(q.rlike(nominee), F.concat(part(nominee, 2), F.lit(" Democratic nominee - "), part(nominee, 1)))
        .when(q.rlike(cup), F.concat(F.lit("World Cup "), part(cup, 2), F.lit(" - "), part(cup, 1), F.lit(" wins")))
        .when(q.rlike(race), F.concat(F.lit("F1 Drivers Championship - "), part(race, 1))).otherwise(F.regexp_replace(q, r"\?$", ""))
    )
    bits = F.split(ticker, "-")
    at = lambda k: F.get(bits, F.lit(k))
    year = F.when(F.length(at(1)) == 2, F.concat(F.lit("20"), at(1))).otherwise(at(1))
    region = F.coalesce(F.create_map(*(F.lit(x) for kv in REGIONS.items() for x in kv))[at(2)], at(2))
    family = lambda name: (F.size(bits) >= 3) & (at(0) == name)
    of_ticker = (
        F.when(family("KXWCCONTINENT"), F.concat(F.lit("World Cup "), year, F.lit(" - "), region, F.lit(" wins"))).when(family("KXF1"), F.concat(F.lit("F1 "), year, F.lit(" Drivers Championship - "), at(2)))
        .when(family("KXPRESNOMD"), F.concat(year, F.lit(" Democratic nominee - "), at(2)))
    )
    return F.coalesce(some(existing), some(of_question), some(of_ticker), some(key), F.trim(F.coalesce(ticker, F.lit(""))))


def found(sources: list[tuple[str, DataFrame]], needle: str) -> DataFrame:
    """The first pair, in the order of the sources and their rows, that has the needle as key or as an identifier."""
    hits = [s.filter((F.col("pair_key") == needle) | (F.col("a_market") == needle) | (F.col("b_condition") == needle)).withColumns({"source": F.lit(n), "_p": F.lit(k)}) for k, (n, s) in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), hits).orderBy("_p", "pair_key").limit(1).drop("_p")


def context(candidates: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Candidates with the discovery record of each leg as a struct, null where there is none."""
    of = lambda x, p: x.select(F.col("market_id").alias(f"_{p}"), F.struct(*x.columns).alias(f"{p}_record"))
    rows = candidates.join(of(a, "a"), F.col("a_market") == F.col("_a"), "left")
    return rows.join(of(b, "b"), F.col("b_market") == F.col("_b"), "left").drop("_a", "_b")


def listing(pairs: DataFrame, after: tuple[str, str] | None, limit: int) -> DataFrame:
    """A page of pairs by lower-case name, then key: what follows `after`, 1 to 100 rows."""
    name = F.lower(F.coalesce(F.nullif(F.col("display_name"), F.lit("")), F.col("pair_key")))
    rows = pairs.withColumn("name_key", name)
    if after is not None:
        rows = rows.filter((F.col("name_key") > after[0]) | ((F.col("name_key") == after[0]) & (F.col("pair_key") > after[1])))
    return rows.orderBy("name_key", "pair_key").limit(min(max(1, limit), 100))


def latest_pack(packs: DataFrame) -> DataFrame:
    """(pair_key, path): of all evidence folders (pair_key, folder, path) of a pair the one with the last name, then path."""
    return packs.groupBy("pair_key").agg(F.max(F.struct("folder", "path")).alias("x")).select("pair_key", F.col("x.path").alias("path"))


def bucket_counts(episodes: DataFrame) -> DataFrame:
    """Evidence of a pair: its episodes and how many are in each bucket, by name."""
    n = episodes.groupBy("pair_key", F.coalesce("bucket", F.lit("unknown")).alias("bucket")).agg(F.count("*").alias("n"))
    return n.groupBy("pair_key").agg(F.sum("n").alias("episode_count"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("buckets"))
