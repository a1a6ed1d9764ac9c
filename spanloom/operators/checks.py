"""Per-run checks. Each gives rows (graph_id, run_id, name, severity, code, params); what can't be read gives no row.

No check needs a row-at-a-time UDF: text is taken apart by built-in functions inside the JVM; only the directories of archives are read,
and figures compared, in Arrow batches.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.columns import glob_regex
from ..functions.jsonview import json_leaves, tolerant
from ..functions.lineage import stored
from ..functions.schemas import breaches, schema_rules
from .bundles import flattened

KEY = ["graph_id", "run_id"]


def signal(df: DataFrame, name: str, severity: str, code: Column | str, **params: Column) -> DataFrame:
    bag = F.create_map(*(x for k, v in params.items() for x in (F.lit(k), v.cast("string")))) if params else F.create_map().cast("map<string,string>")
    return df.select(*KEY, F.lit(name).alias("name"), F.lit(severity).alias("severity"), (F.lit(code) if isinstance(code, str) else code).alias("code"), bag.alias("params"))


# ---- behaviour: tool calls (graph_id, run_id, pos, name, args_sha, status, args) -------------------------------------


def parse_tool_calls(runs: DataFrame) -> DataFrame:
    """Tool calls of a JSON array, or of one object; a call without a name is ?, without a hash it has an empty one."""
    one = "struct<name:string,args_sha:string,status:string,args:string>"
    calls = F.coalesce(F.from_json("tool_calls", f"array<{one}>"), F.array(F.from_json("tool_calls", one)))
    each = runs.select(*KEY, F.posexplode(calls).alias("pos", "c")).where("c is not null")
    return each.select(*KEY, "pos", F.coalesce("c.name", F.lit("?")).alias("name"), F.coalesce("c.args_sha", F.lit("")).alias("args_sha"), F.coalesce("c.status", F.lit("ok")).alias("status"), F.col("c.args").alias("args"))


def loop_fingerprint(calls: DataFrame) -> DataFrame:
    """Two or more equal calls in a row: islands of equal calls by two row numbers."""
    w = W.partitionBy(*KEY).orderBy("pos")
    same = W.partitionBy(*KEY, "name", "args_sha").orderBy("pos")
    islands = calls.withColumn("island", F.row_number().over(w) - F.row_number().over(same)).groupBy(*KEY, "name", "args_sha", "island").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("start")).where("n >= 2")
    return signal(islands.withColumnRenamed("name", "tool"), "loop_fingerprint", "warn", "repeated_call", tool=F.col("tool"), count=F.col("n"), start=F.col("start"))


def retry_storm(calls: DataFrame, threshold: int = 3) -> DataFrame:
    g = calls.groupBy(*KEY, F.col("name").alias("tool"), "args_sha").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("errors")).where((F.col("n") >= threshold) & (F.col("errors") >= 1))
    return signal(g, "retry_storm", "warn", "retries", tool=F.col("tool"), count=F.col("n"), errors=F.col("errors"))


# Parts of tool names that act on the world.
SIDE_EFFECTS = ("send", "mail", "pay", "post", "write", "delete", "create", "submit")


def duplicate_side_effect(calls: DataFrame, markers: tuple[str, ...] = SIDE_EFFECTS) -> DataFrame:
    """The same call twice or more, all of them fine, to a tool that acts on the world."""
    marker = F.coalesce(*(F.when(F.lower("tool").contains(m), F.lit(m)) for m in markers))
    g = calls.groupBy(*KEY, F.col("name").alias("tool"), "args_sha").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("status") == "ok").alias("fine")).where("n >= 2 and fine")
    return signal(g.withColumn("marker", marker).where("marker is not null"), "duplicate_side_effect", "fail", "duplicate_call", tool=F.col("tool"), count=F.col("n"), marker=F.col("marker"))


def metric_anomaly(runs: DataFrame, baselines: DataFrame, metric: str, name: str, z: float = 3.0, least: int = 5) -> DataFrame:
    """``metric`` at or above z deviations over the agent's mean. baselines: agent_name, metric, n, mean, std."""
    b = baselines.where((F.col("metric") == metric) & (F.col("std") > 0) & (F.col("n") >= least)).select("agent_name", "mean", "std")
    x = runs.join(b, "agent_name").withColumn("z", (F.col(metric) - F.col("mean")) / F.col("std")).where(F.col("z") >= z)
    return signal(x, name, "warn", "z_score", z=F.round("z", 3))


def empty_output(runs: DataFrame) -> DataFrame:
    """An output that is blank, not missing, though tokens were paid for."""
    return signal(runs.where("output is not null and trim(output) = '' and tokens_out > 0"), "empty_output", "fail", "blank_output", tokens_out=F.col("tokens_out"))


def zero_result_set(runs: DataFrame) -> DataFrame:
    """A JSON output without a record: every list empty, every number zero, every text an echo of the input."""
    leaves = json_leaves(runs.where("output is not null"), KEY, "output").join(runs.select(*KEY, F.lower("input").alias("asked")), KEY)
    number = F.col("value").try_cast("double")
    kind = F.upper("type")
    word = F.concat(F.lit("(?U)(?<!\\w)\\Q"), F.lower("value"), F.lit("\\E(?!\\w)"))
    echoed = F.coalesce(F.regexp_like("asked", word), F.lit(False))
    record = F.when(kind.isin("BOOLEAN", "VOID"), F.lit(False)).when(number.isNotNull() & (kind != "STRING"), number != 0).otherwise((F.trim("value") != "") & ~echoed)
    some = leaves.where(record).select(*KEY).distinct()
    parsed = runs.where(F.schema_of_variant(tolerant(F.col("output"))).rlike("^(OBJECT|ARRAY)"))
    return signal(parsed.join(some, KEY, "left_anti"), "zero_result_set", "warn", "no_records")


def run_failed(runs: DataFrame) -> DataFrame:
    return signal(runs.where("status = 'failed'"), "run_failed", "fail", "failed_status")


# ---- content ----------------------------------------------------------------------------------------------------------


def section_present(text: Column, match: Column, pattern: Column, exact: Column) -> Column:
    """substring, word_prefix or regex; null for a kind that isn't known. Case counts only where ``exact``."""
    body = F.coalesce(text, F.lit(""))
    low, want = F.lower(body), F.lower(pattern)
    words = F.regexp_extract_all(low, F.lit("(?U)\\w+"), F.lit(0))
    return (F.when(match == "substring", F.when(exact, F.contains(body, pattern)).otherwise(F.contains(low, want))).when(match == "word_prefix", F.exists(words, lambda w: F.startswith(w, want)))
            .when(match == "regex", F.regexp_like(body, F.concat(F.when(exact, "").otherwise("(?iu)"), pattern))))


def usable_patterns(rules: DataFrame) -> DataFrame:
    """``rules`` without those whose regular expression is malformed. Rules are written by people and few; each distinct pattern is compiled once,
    one after another as they stream by, and only the bad ones are kept."""
    jvm = rules.sparkSession.sparkContext._jvm
    bad = []
    for row in rules.where("match = 'regex'").select("pattern").distinct().toLocalIterator():
        try:
            jvm.java.util.regex.Pattern.compile(row.pattern)
        except (Py4JJavaError, IllegalArgumentException):
            bad.append(row.pattern)
    return rules.where(~((F.col("match") == "regex") & F.col("pattern").isin(bad))) if bad else rules


def required_section(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """A fail a rule whose section the output lacks. rules: agent_name (null: any), name, match, pattern, case_sensitive. A rule with a malformed
    regular expression, or of a kind that isn't known, gives nothing. Rules of one agent are joined by its name, those of any agent are
    one list beside the rows."""
    r = usable_patterns(rules).select("agent_name", F.struct(F.col("name").alias("section"), "match", "pattern", F.coalesce("case_sensitive", F.lit(False)).alias("exact")).alias("r"))
    common = r.where("agent_name is null").agg(F.collect_list("r").alias("any_rules"))  # one row
    own = r.where("agent_name is not null").groupBy("agent_name").agg(F.collect_list("r").alias("own_rules"))
    both = runs.join(own, "agent_name", "left").crossJoin(F.broadcast(common))
    both = both.withColumn("r", F.explode(F.concat(F.coalesce("own_rules", F.array().cast(own.schema["own_rules"].dataType)), "any_rules")))
    return signal(both.where(~section_present(F.col("output"), F.col("r.match"), F.col("r.pattern"), F.col("r.exact"))), "missing_required_section", "fail", "section_absent", section=F.col("r.section"))


def sum_invariant(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """Items that don't add up to the stated total. rules: items, field, total (paths), tolerance."""
    r = rules.select("items", "field", "total", F.coalesce("tolerance", F.lit(0.01)).alias("tolerance"))
    both = runs.join(F.broadcast(r)).withColumn("v", tolerant(F.col("output")))
    values = F.expr("try_variant_get(v, concat('$.', items), 'array<variant>')")
    field = F.transform(values, lambda x: F.try_variant_get(x, F.concat(F.lit("$."), F.col("field")), "double"))
    both = both.withColumn("sum", F.aggregate(F.filter(field, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)).withColumn("stated", F.expr("try_variant_get(v, concat('$.', total), 'double')"))
    return signal(both.where("stated is not null and sum is not null and abs(sum - stated) > tolerance"), "numeric_invariant_breach", "fail", "sum_differs", sum=F.round("sum", 4), stated=F.round("stated", 4))


# Words and signs of currency families.
CURRENCIES = {"CZK": "(?U)(?<!\\w)(?:czk|kč)(?!\\w)", "EUR": "(?U)(?<!\\w)eur(?!\\w)|€", "GBP": "(?U)(?<!\\w)gbp(?!\\w)|£", "USD": "(?U)(?<!\\w)usd(?!\\w)|\\$"}


def currency_families(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(k)) for k, p in CURRENCIES.items())))


def unit_inconsistency(runs: DataFrame) -> DataFrame:
    """One currency in the input; others, and not that one, in the output."""
    x = runs.where("input is not null and output is not null").withColumn("a", currency_families(F.col("input"))).withColumn("b", currency_families(F.col("output")))
    x = x.where((F.size("a") == 1) & (F.size("b") > 0) & ~F.array_contains("b", F.element_at("a", 1)))
    return signal(x, "unit_inconsistency", "warn", "currency_family_mismatch", input_family=F.element_at("a", 1), output_families=F.array_join("b", ", "))


def iso_time(text: Column) -> Column:
    found = F.regexp_extract(text, "^\\s*(\\d{4}-\\d{2}-\\d{2}(?:[T ]\\d{2}:\\d{2}(?::\\d{2})?)?)", 1)
    return F.try_to_timestamp(F.when(found != "", found))


def temporal_invariant(leaves: DataFrame, runs: DataFrame) -> DataFrame:
    """A start after its sibling end or deadline, at any depth; or a deadline before the run began. leaves: of the outputs."""
    t = leaves.select(*KEY, "parent_path", F.lower("key_name").alias("k"), iso_time(F.col("value")).alias("t")).where("t is not null")
    start = t.where("k like '%start%'").select(*KEY, "parent_path", F.col("k").alias("k1"), F.col("t").alias("t1"))
    end = t.where("k like '%end%' or k like '%deadline%'").select(*KEY, "parent_path", F.col("k").alias("k2"), F.col("t").alias("t2"))
    a = signal(start.join(end, [*KEY, "parent_path"]).where("t1 > t2 and k1 <> k2").select(*KEY, "k1", "k2").distinct(), "temporal_invariant_breach", "warn", "start_after_end", first=F.col("k1"), second=F.col("k2"))
    due = t.where("k like '%deadline%' or k like '%due%'").join(runs.select(*KEY, F.to_date("started_at").alias("day")), KEY).where("to_date(t) < day").select(*KEY, "k").distinct()
    return a.unionByName(signal(due, "temporal_invariant_breach", "warn", "due_before_start", first=F.col("k"), second=F.lit("run")))


def train_lang_profiles(corpus: DataFrame) -> DataFrame:
    """(lang, gram, logp): smoothed log shares of letter trigrams by language, from a labelled corpus (text, lang); one shuffle."""
    grams = corpus.where("lang is not null").select("lang", F.explode(_trigrams(F.col("text"))).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    total = grams.groupBy("lang").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("v"))
    return grams.join(F.broadcast(total), "lang").select("lang", "gram", F.ln((F.col("n") + 0.5) / (F.col("t") + 0.5 * F.col("v"))).alias("logp"), F.ln(0.5 / (F.col("t") + 0.5 * F.col("v"))).alias("floor"))


def _trigrams(text: Column) -> Column:
    """Every three characters in a row, of letters in lower case with one space between words: one pass of a pattern that looks ahead."""
    clean = F.regexp_replace(F.lower(text), "(?U)[^\\p{L}]+", " ")
    return F.regexp_extract_all(clean, F.lit("(?s)(?=(...))"), F.lit(1))


def detect_language(texts: DataFrame, profiles: DataFrame) -> DataFrame:
    """texts (id, text) → (id, lang, p): the language with the highest sum of log shares. What is shuffled is one sum a text and language: a
    text's trigrams meet the profiles, which are as many as an alphabet gives, where they are read."""
    langs = profiles.select("lang", "floor").distinct().orderBy("lang").collect()  # one row a language
    over = profiles.groupBy("gram").agg(*(F.max(F.when(F.col("lang") == x.lang, F.col("logp") - x.floor)).alias(f"_{i}") for i, x in enumerate(langs)))
    grams = texts.select("id", F.explode(_trigrams(F.col("text"))).alias("gram")).join(stored(over), "gram", "left")
    sums = grams.groupBy("id").agg(F.count(F.lit(1)).alias("size"), *(F.sum(f"_{i}").alias(f"_{i}") for i in range(len(langs))))
    each = F.array(*(F.struct(F.lit(x.lang).alias("lang"), (F.coalesce(f"_{i}", F.lit(0.0)) + F.col("size") * x.floor).alias("ll")) for i, x in enumerate(langs)))
    score = sums.select("id", F.explode(each).alias("e")).select("id", "e.*") if langs else texts.where("false").select("id", F.lit("").alias("lang"), F.lit(0.0).alias("ll"))
    best = score.groupBy("id").agg(F.max("ll").alias("top"), F.max_by("lang", F.struct("ll", "lang")).alias("lang"), F.sort_array(F.collect_list("ll")).alias("all"))
    total = F.aggregate("all", F.lit(0.0), lambda t, x: t + F.exp(F.greatest(F.lit(-50.0), x - F.col("top"))))
    return best.select("id", "lang", (1 / total).alias("p"))


def language_mismatch(runs: DataFrame, profiles: DataFrame, least: int = 120, sure: float = 0.90) -> DataFrame:
    """Outputs of ``least`` characters or more in another language than runs.expected_lang."""
    texts = runs.where((F.length("output") >= least) & F.col("expected_lang").isNotNull()).select(F.struct(*KEY).alias("id"), F.col("output").alias("text"))
    found = detect_language(texts, profiles).where(F.col("p") >= sure).select("id.graph_id", "id.run_id", "lang")
    x = runs.join(found, KEY).where("lang <> expected_lang")
    return signal(x, "language_mismatch", "fail", "other_language", expected=F.col("expected_lang"), found=F.col("lang"))


# ---- numbers -----------------------------------------------------------------------------------------------------------

# Forms of figures and of stated rates; delimiters in the order in which they are tried.
FIGURE = "(?U)(?<![\\w.])-?\\d{1,3}(?:[  ]\\d{3})+(?:[.,]\\d+)?(?!\\w)|(?<![\\w.])-?\\d+(?:[.,]\\d+)?(?!\\w)"
RATES = ("(?i)1\\s*[A-Z]{3}\\s*=\\s*(\\d+(?:[.,]\\d+)?)", "(?i)(?:kurz|rate|exchange)\\s*:?\\s*(\\d+(?:[.,]\\d+)?)")
DELIMITERS = (";", "\t", "|", ",")
FACTORS = (1.0, 10.0, 100.0, 1000.0, 10000.0)


def parse_number(token: Column) -> Column:
    """A figure with either decimal mark; where both marks stand, the last is the decimal mark."""
    t = F.regexp_replace(token, "[  ]", "")
    comma_last = F.length(F.substring_index(t, ",", -1)) < F.length(F.substring_index(t, ".", -1))
    both = F.contains(t, F.lit(",")) & F.contains(t, F.lit("."))
    plain = F.when(both & comma_last, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(both, F.replace(t, F.lit(","), F.lit(""))).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    return plain.try_cast("double")


def _delimiter(line: Column) -> Column:
    return F.coalesce(*(F.when(F.length(line) - F.length(F.replace(line, F.lit(d), F.lit(""))) >= 2, F.lit(d)) for d in DELIMITERS))


def payload_lines(texts: DataFrame, key: list[str], column: str) -> DataFrame:
    """key…, no, line, delimiter of every line."""
    return texts.select(*key, F.posexplode(F.split(F.col(column), "\\r\\n|\\n|\\r")).alias("no", "line")).withColumn("delimiter", _delimiter(F.col("line")))


def payload_numbers(texts: DataFrame, key: list[str], column: str) -> DataFrame:
    """key…, value of every figure; a delimited line is read cell by cell."""
    lines = payload_lines(texts, key, column)
    cells = F.when(F.col("delimiter").isNull(), F.array("line")).otherwise(F.split("line", F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E"))))
    tokens = lines.select(*key, F.explode(cells).alias("cell")).select(*key, F.explode(F.regexp_extract_all(F.trim("cell"), F.lit(FIGURE), F.lit(0))).alias("token"))
    return tokens.select(*key, parse_number(F.col("token")).alias("value")).where("value is not null")


def figures(lines: Column, delimiters: Column) -> Column:
    """The values of all figures in a text's ``lines``, as ``payload_numbers`` reads them."""
    cells = F.zip_with(lines, delimiters, lambda line, d: F.when(d.isNull(), F.array(line)).otherwise(F.split(line, F.concat(F.lit("\\Q"), d, F.lit("\\E")))))
    tokens = F.flatten(F.transform(F.flatten(cells), lambda cell: F.regexp_extract_all(F.trim(cell), F.lit(FIGURE), F.lit(0))))
    return F.array_compact(F.transform(tokens, parse_number))


def tabular(delimiters: Column) -> Column:
    """Whether two neighbouring lines have one delimiter."""
    return F.exists(F.zip_with(delimiters, F.slice(delimiters, 2, F.size(delimiters)), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda same: same)


def numeric_content_lost(runs: DataFrame, least: int = 8, chars: int = 200) -> DataFrame:
    """Many figures in, none out, though there is much text."""
    out = runs.where(F.length(F.trim("output")) >= chars)
    count = payload_numbers(out, KEY, "input").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return signal(count.join(payload_numbers(out, KEY, "output").select(*KEY).distinct(), KEY, "left_anti"), "numeric_content_lost", "fail", "numeric_content_lost", input_numbers=F.col("n"))


def _placed(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(row, value) as one number that sorts by both."""
    out = np.empty(len(rows), np.complex128)
    out.real, out.imag = rows, values
    return out


def _distinct(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row and value of each list's distinct figures, in order."""
    values, rows = flattened(lists)
    values = values.to_numpy(zero_copy_only=False)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[fresh], values[fresh]


def _lost(given: pa.Array, rates: pa.Array, stated: pa.Array, tolerance: float) -> np.ndarray:
    """By row, how many distinct figures of ``stated`` nothing gives. A factor keeps the order of the given figures, and of what they make
    only the next below and above a stated figure can be near enough: each factor is one search of sorted numbers."""
    (own, value), (row, base), (of, rate) = map(_distinct, (stated, given, rates))
    found, place, zero, wanted = np.zeros(len(own), bool), _placed(own, value), np.zeros(len(given), bool), np.arange(len(own))
    nth = np.arange(len(of)) - np.searchsorted(of, of)
    turns = np.split(np.argsort(nth, kind="stable"), np.cumsum(np.bincount(nth)))[:-1]  # the first rate of each row, the second …
    for f in (*FACTORS, *turns):
        wanted = wanted[~found[wanted]]
        if isinstance(f, np.ndarray):
            by_row = np.full(len(given), np.nan)
            by_row[of[f]] = rate[f]
            at = by_row[row] == by_row[row]  # rows without such a rate have none that follows
            row, base, wanted = row[at], base[at], wanted[by_row[own[wanted]] == by_row[own[wanted]]]
            f = by_row[row]
        for made in (base * f, base / f):
            rows, made = row[made == made], made[made == made]
            zero[rows[made == 0]] = True
            above = np.searchsorted(_placed(rows, made), place[wanted], side="right")
            for i in (above - 1, above):
                there = (i >= 0) & (i < len(rows))
                there[there] = (rows[i[there]] == own[wanted[there]]) & (np.sign(made[i[there]]) == np.sign(value[wanted[there]])) & (made[i[there]] != 0)
                m, v = made[i[there]], value[wanted[there]]
                found[wanted[there][np.abs(v - m) / np.abs(m) <= tolerance]] = True
    found |= (value == 0) & zero[own]
    return np.bincount(own[~found], minlength=len(given))


#: A batch is searched in parts of about so many figures; a run stays whole.
FIGURES = 1 << 18


def number_not_derivable(runs: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Figures of a tabular output that no input figure gives, alone, scaled by a power of ten, or by a rate that the input states.

    A run stands in one row, and its figures stay there: nothing is shuffled, and only how many a run has lost is stored. In a run the work
    grows with its figures and their logarithm, times its rates.
    """
    split = lambda c: F.split(F.col(c), "\\r\\n|\\n|\\r")
    x = runs.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in KEY))).select(*KEY, "input", split("input").alias("i"), split("output").alias("o"))
    x = x.withColumns({"di": F.transform("i", _delimiter), "do": F.transform("o", _delimiter)}).where(tabular(F.col("do")))
    rates = F.transform(F.flatten(F.array(*(F.regexp_extract_all("input", F.lit(p), F.lit(1)) for p in RATES))), parse_number)
    x = x.select(*KEY, figures(F.col("i"), F.col("di")).alias("given"), F.filter(rates, lambda f: (f > 0) & (f != 1)).alias("rates"), figures(F.col("o"), F.col("do")).alias("stated"))
    out = T.StructType([*(x.schema[k] for k in KEY), T.StructField("n", T.LongType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            size = sum(pc.fill_null(pc.list_value_length(part.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("given", "rates", "stated"))
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // FIGURES, prepend=0))
            for a, b in zip([0, *cuts], [*cuts, part.num_rows], strict=True):
                some = part.slice(a, b - a)
                with np.errstate(all="ignore"):
                    n = _lost(*(some.column(c) for c in ("given", "rates", "stated")), tolerance)
                kept = pa.array(np.flatnonzero(n))
                yield pa.RecordBatch.from_arrays([*(some.column(k).take(kept) for k in KEY), pa.array(n, pa.int64()).take(kept)], names=out.names)

    return signal(stored(x.mapInArrow(run, out)), "number_not_derivable", "fail", "number_not_derivable", count=F.col("n"))


# ---- security ------------------------------------------------------------------------------------------------------------

# Forms of sensitive data.
SENSITIVE = {
    "email address": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}",
    "phone number": "\\+\\d[\\d \\-()]{7,}\\d",
    "IBAN": "\\b[A-Z]{2}\\d{2}[A-Za-z0-9]{11,30}\\b",
    "payment card number": "(?<![\\dA-Za-z])(?:\\d[ -]?){12,18}\\d(?![\\dA-Za-z])",
    "AWS access key id": "\\bAKIA[0-9A-Z]{16}\\b",
    "private key": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "JWT": "\\b[A-Za-z0-9_-]{4,}\\.[A-Za-z0-9_-]{4,}\\.[A-Za-z0-9_-]{4,}\\b",
    "high-entropy token (possible secret)": "(?<!\\S)[A-Za-z0-9+/=]{32,}(?!\\S)",
}


def luhn(digits: Column) -> Column:
    back = F.split(F.reverse(digits), "")
    value = F.transform(F.filter(back, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def iban(code: Column) -> Column:
    moved = F.upper(F.concat(F.substring(code, 5, 100), F.substring(code, 1, 4)))
    digits = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda a, x: F.when(x > 9, (a * 100 + x) % 97).otherwise((a * 10 + x) % 97)) == 1


def entropy(token: Column) -> Column:
    """Bits a character."""
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - (F.size(F.filter(chars, lambda x: x == c)) / F.length(token)) * F.log2(F.size(F.filter(chars, lambda x: x == c)) / F.length(token)))


def jwt_header(token: Column) -> Column:
    head = F.translate(F.substring_index(token, ".", 1), "-_", "+/")
    padded = F.rpad(head, (F.ceil(F.length(head) / 4) * 4).cast("int"), F.lit("="))
    return F.get_json_object(F.try_to_binary(padded, F.lit("base64")).cast("string"), "$.alg").isNotNull()


def sensitive_kinds(text: Column) -> Column:
    """Array of (kind, prefix): each kind once, with four characters of its first match."""
    good = {"phone number": lambda m: F.length(F.regexp_replace(m, "\\D", "")) >= 9, "IBAN": iban, "payment card number": lambda m: luhn(F.regexp_replace(m, "[ -]", "")),
            "JWT": jwt_header, "high-entropy token (possible secret)": lambda m: entropy(m) > 4.5}
    out = []
    for kind, form in SENSITIVE.items():
        found = F.regexp_extract_all(text, F.lit(form), F.lit(0))
        first = F.get(F.filter(found, good[kind]) if kind in good else found, F.lit(0))
        out.append(F.when(first.isNotNull(), F.struct(F.lit(kind).alias("kind"), F.left(first, F.lit(4)).alias("prefix"))))
    return F.array_compact(F.array(*out))


def sensitive_data(runs: DataFrame, column: str = "output") -> DataFrame:
    x = runs.select(*KEY, F.explode(sensitive_kinds(F.col(column))).alias("s"))
    return signal(x, "sensitive_data_exposure", "warn", "sensitive_data", kind=F.col("s.kind"), prefix=F.col("s.prefix"))


# Phrases and characters of injected prompts.
INJECTIONS = ("ignore previous instructions", "ignore all prior", "disregard your instructions", "you are now", "system prompt", "reveal your instructions")
ZERO_WIDTH, BIDI, IMAGE = "[\\u200b-\\u200f\\u2060-\\u2064]", "[\\u202a-\\u202e\\u2066-\\u2069]", "!\\[[^\\]]*\\]\\(\\s*(\\S+?)\\s*\\)"


def prompt_injection(runs: DataFrame, column: str = "output") -> DataFrame:
    low, text = F.lower(column), F.col(column)
    urls = F.regexp_extract_all(text, F.lit(IMAGE), F.lit(1))
    long_value = F.exists(urls, lambda u: F.exists(F.split(F.when(u.contains("?"), F.substring_index(F.substring_index(u, "?", -1), "#", 1)).otherwise(""), "&"), lambda q: F.length(F.when(q.contains("="), F.substring_index(q, "=", -1)).otherwise("")) > 64))
    marks = [*(F.when(low.contains(p), F.lit(p)) for p in INJECTIONS), F.when(text.rlike(ZERO_WIDTH), F.lit("zero-width characters")), F.when(text.rlike(BIDI), F.lit("bidi control characters")), F.when(long_value, F.lit("markdown image exfiltration URL"))]
    x = runs.select(*KEY, F.explode(F.array_compact(F.array(*marks))).alias("s"))
    return signal(x, "prompt_injection_signature", "warn", "prompt_injection", signature=F.col("s"))


# ---- artifacts -------------------------------------------------------------------------------------------------------------

# Kinds of file that an extension stands for.
EXTENSION_KINDS = {"docx": "zip", "pptx": "zip", "xlsx": "zip", "zip": "zip", "pdf": "pdf", "txt": "text", "md": "text", "csv": "text", "json": "text", "html": "text"}


def artifact_integrity(runs: DataFrame, min_bytes: int = 64) -> DataFrame:
    """Declared artifacts (JSON list in artifact_meta) that are missing, of another kind, unreadable, empty or too small."""
    kind = "array<struct<path:string,exists:boolean,size:bigint,ext:string,detected_kind:string,parse_ok:boolean,nonempty:boolean>>"
    a = runs.select(*KEY, F.explode(F.from_json("artifact_meta", kind)).alias("a")).select(*KEY, "a.*")
    wanted = F.element_at(F.create_map(*(x for k, v in EXTENSION_KINDS.items() for x in (F.lit(k), F.lit(v)))), F.lower("ext"))
    bad = F.array_compact(F.array(F.when(~F.coalesce("exists", F.lit(True)), "missing"), F.when(wanted != F.col("detected_kind"), "kind_mismatch"), F.when(~F.col("parse_ok"), "unreadable"), F.when(~F.col("nonempty"), "empty"), F.when(F.col("size") < min_bytes, "too_small")))
    return signal(a.select(*KEY, "path", F.explode(bad).alias("why")), "artifact_integrity_fail", "fail", F.col("why"), path=F.col("path"))


DOC_REF, MEDIA_REF = "(?i)(?U)[\\w./\\\\:-]+\\.(?:docx|doc|pdf|pptx|ppt|xlsx|xls|zip|tar|gz|bin)\\b", "(?i)(?U)[\\w./\\\\:-]+\\.(?:png|jpe?g|gif|webp|svg)\\b"
MD_EMBED, IMG_EMBED = "!\\[[^\\]\\n]*\\]\\([^)\\n]*\\)", "(?i)<img\\b[^>]*>"


def artifact_visibility(text: Column) -> Column:
    """(state, refs): visible, partial (readable, with pictures that nobody opened) or opaque (it only points at a file)."""
    refs = lambda p: F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    docs, media = refs(DOC_REF), refs(MEDIA_REF)
    marked = text.contains("[artifact_text ") | text.contains('"artifact_text"')
    embedded = text.rlike(MD_EMBED.replace("[^)\\n]*\\)", "\\s*<?[^)\\s>]+\\.(?i:png|jpe?g|gif|webp|svg)")) | text.rlike("(?i)<img\\b[^>]*?\\bsrc\\s*=\\s*[\"']?[^\"'>\\s]+\\.(?:png|jpe?g|gif|webp|svg)")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, MD_EMBED, " "), IMG_EMBED, " "), DOC_REF, " "), MEDIA_REF, " ")
    prose = F.regexp_count(body, F.lit("(?U)[^\\W\\d_]{2,}"))
    none = F.array().cast("array<string>")
    s = lambda state, r: F.struct(F.lit(state).alias("state"), r.alias("refs"))
    return (F.when(text.isNull() | (text == ""), s("visible", none)).when(marked & (F.size(media) > 0), s("partial", media)).when(marked, s("visible", none)).when(F.size(docs) > 0, s("opaque", docs))
            .when(F.size(media) == 0, s("visible", none)).when(embedded & (prose >= 60), s("partial", media)).otherwise(s("opaque", media)))


# ---- contracts ---------------------------------------------------------------------------------------------------------------

# Parameters that a run must carry on unchanged.
CONTRACT_KEYS = ("file_type", "filetype", "format", "target_format", "doc_kind", "medium", "lang", "language", "locale")


def contract_violations(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(graph_id, run_id, key, from, to) for parameters with one value on each side (without regard to case) that differ. Both: json_leaves."""
    def single(leaves: DataFrame, name: str) -> DataFrame:
        k = leaves.select(*KEY, F.lower("key_name").alias("key"), F.trim("value").alias("v")).where(F.col("key").isin(*CONTRACT_KEYS) & F.col("v").isNotNull() & (F.col("v") != ""))
        return k.groupBy(*KEY, "key").agg(F.count_distinct(F.lower("v")).alias("n"), F.min("v").alias(name)).where("n = 1").drop("n")

    return single(inputs, "from").join(single(outputs, "to"), [*KEY, "key"]).where("lower(`from`) <> lower(`to`)")


def select_contract(runs: DataFrame, contracts: DataFrame) -> DataFrame:
    """graph_id, run_id, json_schema: the first contract (by ord) of the agent whose version glob fits; contracts are few."""
    c = F.broadcast(contracts.select("agent_name", "version_glob", "json_schema", "ord"))
    both = runs.join(c, "agent_name").where(F.regexp_like(F.coalesce("agent_version", F.lit("")), glob_regex(F.col("version_glob"))))
    return both.groupBy(*KEY).agg(F.min_by("json_schema", "ord").alias("json_schema"))


def schema_component(runs: DataFrame, contracts: DataFrame) -> DataFrame:
    """graph_id, run_id, schema: 1.0 where the output fits the agent's contract, else 0.0; no row without a contract. An output that is no JSON
    doesn't fit; a contract that is none asks nothing. Eight levels below the top are checked: if all is well there and output and contract
    both go deeper, the component is null, as it wasn't measured."""
    chosen = runs.join(select_contract(runs, contracts), KEY).select(*KEY, "json_schema", F.try_parse_json("output").alias("v"))
    rules = schema_rules(contracts.select("json_schema").distinct(), "json_schema", "json_schema")
    bad = breaches(chosen, KEY, rules, "json_schema").groupBy(*KEY).agg(F.bool_or(F.col("reason") != "deeper").alias("breach"))
    out = chosen.join(bad, KEY, "left")
    return out.select(*KEY, F.when(F.col("v").isNull() | F.col("breach"), 0.0).when(F.col("breach").isNull(), 1.0).alias("schema"))


def tool_args_invalid(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Tools that a run called with arguments that don't fit the tool's registered schema, once each, with the first breach (by path). calls:
    args (JSON; calls without, or with text that is no JSON, give nothing). rules: tool, json_schema, ord (the first of a tool counts)."""
    first = rules.groupBy(F.col("tool").alias("name")).agg(F.min_by("json_schema", "ord").alias("json_schema"))
    x = calls.join(first.select("name"), "name").select(*KEY, F.col("name").alias("tool"), F.try_parse_json("args").alias("v"))
    asked = schema_rules(first.withColumnRenamed("name", "tool"), "tool", "json_schema")
    bad = breaches(x.withColumn("named", F.col("tool")), [*KEY, "named"], asked, "tool").where("reason <> 'deeper'")
    bad = bad.groupBy(*KEY, F.col("named").alias("tool")).agg(F.min(F.struct("path", "reason")).alias("x")).select(*KEY, "tool", F.concat(F.lit("$"), F.array_join("x.path", "")).alias("path"), "x.reason")
    return signal(bad, "tool_args_invalid", "fail", "tool_args_invalid", tool=F.col("tool"), path=F.col("path"), breach=F.col("reason"))


# What keys of a payload tell of.
LIFECYCLE = ["ok", "okay", "success", "succeeded", "successful", "status", "state", "step", "stage", "phase", "done", "complete", "completed", "finished", "error", "errors", "failed", "failure", "running", "pending", "skipped"]
TELEMETRY = ["count", "n", "total", "index", "i", "iteration", "iter", "attempt", "attempts", "retries", "retry", "progress", "percent", "elapsed", "elapsed_ms", "duration", "duration_ms", "latency_ms", "ts", "timestamp", "time", "started", "ended", "start", "end"]
AMBIGUOUS = ["result", "results", "message", "msg", "action", "event", "node", "code", "output", "answer", "response", "reply", "decision", "label", "category", "class", "verdict", "reason", "summary", "value", "data", "text", "content", "type", "kind", "name", "id"]
STATUS_WORDS = ["ok", "okay", "done", "success", "succeeded", "successful", "complete", "completed", "finished", "failed", "failure", "error", "true", "false", "null", "none", "noop", "pass", "passed", "fail", "n/a", "na"]


def payload_kind(text: Column) -> Column:
    """empty, ping (tells that a step ran), unclear, or work."""
    t = F.trim(F.coalesce(text, F.lit("")))
    v = F.try_variant_get(F.try_parse_json(t), "$", "map<string,variant>")
    wordy = lambda s: (F.length(F.trim(s)) >= 60) | (F.size(F.split(F.trim(s), "\\s+")) >= 3)
    rows = F.transform(F.map_entries(v), lambda e: F.struct(F.lower(F.regexp_replace(F.trim(e["key"]), "^_+|_+$", "")).alias("k"), F.schema_of_variant(e["value"]).alias("t"), F.try_variant_get(e["value"], "$", "string").alias("s")))
    among = lambda words: lambda e: F.array_contains(F.array(*map(F.lit, words)), e["k"])
    life, tele, amb = among(LIFECYCLE), among(TELEMETRY), among(AMBIGUOUS)
    content = lambda e: F.when(e["t"] == "STRING", F.when(life(e), F.length(F.trim(e["s"])) >= 60).otherwise(wordy(e["s"]))).when(e["t"].rlike("^(OBJECT|ARRAY)"), e["t"].contains("STRING") & wordy(e["s"])).otherwise(False)
    token = lambda e: ~life(e) & ~tele(e) & ~amb(e) & e["t"].rlike("^(STRING|OBJECT|ARRAY)")
    some = lambda f: F.exists(rows, f)
    obj = F.when(some(content), "work").when(some(life) & ~some(amb) & ~some(token), "ping").when(some(token) & ~some(life) & ~some(amb), "work").otherwise("unclear")
    bare = F.array_contains(F.array(*map(F.lit, STATUS_WORDS)), F.lower(F.regexp_replace(t, "^[.!;:,\"'`*\\s]+|[.!;:,\"'`*\\s]+$", "")))
    return F.when((t == "") | t.isin("{}", "[]", "null", '""', "''"), "empty").when(F.length(t) > 600, "work").when(v.isNotNull(), obj).when(bare, "ping").when(wordy(t), "work").otherwise("unclear")


def structured_claims(leaves: DataFrame, most: int = 6) -> DataFrame:
    """(graph_id, run_id, claims): up to ``most`` distinct scalars of a JSON output, numbers and texts of 3 to 80 characters; telling ones (with a
    digit, a space, or 12 characters) first, else as they stand in the document. leaves: json_leaves with ``place``
    (``ordered``)."""
    claim = F.when(F.col("type") == "STRING", F.trim("value")).otherwise(F.col("value"))
    number = F.col("value").try_cast("double").isNotNull() & ~F.col("type").isin("STRING", "BOOLEAN")
    each = leaves.withColumn("claim", claim).where(number | ((F.col("type") == "STRING") & F.length("claim").between(3, 80)))
    once = each.groupBy(*KEY, "claim").agg(F.min("place").alias("place"))
    dull = ~(F.col("claim").rlike("\\d") | F.contains("claim", F.lit(" ")) | (F.length("claim") >= 12))
    return once.groupBy(*KEY).agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct(dull.alias("dull"), "place", "claim"))), lambda x: x["claim"]), 1, most).alias("claims"))


def claim_matches(claim: Column, text: Column) -> Column:
    """The claim as it is, or 60 % of its words over three letters, without regard to case."""
    low = F.lower(text)
    words = F.filter(F.regexp_extract_all(F.lower(claim), F.lit("(?U)\\w+"), F.lit(0)), lambda w: F.length(w) > 3)
    return F.contains(low, F.lower(claim)) | ((F.size(words) > 0) & (F.size(F.filter(words, lambda w: F.contains(low, w))) >= 0.6 * F.size(words)))


# The member that makes an archive a document of its kind, and the extensions that stand for text.
MAIN_PART = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml", "pptx": "ppt/presentation.xml"}
TEXT_EXTENSIONS = ("md", "txt", "html", "json")


def _opens(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each archive (path, content, wanted member) has a directory that names the member. Files are held one at a time."""
    for part in parts:
        out = []
        for content, wanted in zip(part.column(1), part.column(2).to_pylist(), strict=True):
            try:
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                    out.append(wanted in z.namelist())
            except (zipfile.BadZipFile, OSError, ValueError, EOFError, NotImplementedError):
                out.append(False)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.bool_())], names=["path", "opened"])


def file_meta(files: DataFrame) -> DataFrame:
    """path, size, sha256, declared_ext, detected_kind, parse_ok, nonempty of a table of files (Spark's binaryFile source; a path each).

    parse_ok goes by the extension: office documents must have a directory of members with their main part, PDF its first and last marks,
    texts must be UTF-8 and JSON must parse; of other files it asks only that they aren't empty. A null content is a missing file."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    # A sample may end within a character: up to three bytes are left off.
    sample = F.coalesce(*(F.when(F.is_valid_utf8(cut), cut) for cut in (F.substring("content", 1, F.least(F.octet_length("content"), F.lit(4096)) - k).cast("string") for k in range(4))))
    shown = F.regexp_count(sample, F.lit("[^\\p{C}\\p{Z}]|[ \\t\\n\\r]"))
    head = F.hex(F.substring("content", 1, 4))
    kind = (F.when(F.col("content").isNull(), "missing").when(F.octet_length("content") == 0, "empty").when(head == "504B0304", "zip").when(head == "25504446", "pdf")
            .when(sample.isNotNull() & (shown >= 0.85 * F.length(sample)), "text").otherwise("binary"))
    ext = F.lower(F.regexp_extract("path", "[^/]\\.([^./]+)$", 1))
    meta = files.select("path", "content", F.coalesce(F.octet_length("content"), F.lit(0)).alias("size"), F.sha2("content", 256).alias("sha256"), ext.alias("declared_ext"), kind.alias("detected_kind"),
                        (head == "25504446").alias("_pdf"), F.contains(F.substring("content", -1024, 1024), F.lit(b"%%EOF")).alias("_eof"), text.isNotNull().alias("_utf8"), F.try_parse_json(text).isNotNull().alias("_json"))
    parts = F.create_map(*(F.lit(x) for pair in MAIN_PART.items() for x in pair))
    office = files.select("path", "content", F.element_at(parts, ext).alias("wanted")).where("wanted is not null and content is not null").mapInArrow(_opens, "path string, opened boolean")
    ok = (F.when(F.col("declared_ext").isin(*MAIN_PART), F.col("opened")).when(F.col("declared_ext") == "pdf", F.col("_pdf") & F.col("_eof")).when(F.col("declared_ext") == "json", F.col("_json"))
          .when(F.col("declared_ext").isin(*TEXT_EXTENSIONS), F.col("_utf8")).otherwise(F.col("size") > 0))
    return meta.join(office, "path", "left").select("path", "size", "sha256", "declared_ext", "detected_kind", F.coalesce(F.col("content").isNotNull() & ok, F.lit(False)).alias("parse_ok"), (F.col("size") > 0).alias("nonempty"))
