"""Masking of texts, masking events and the dictionary of sensitive terms."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import chain
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dlp
from ..functions.batches import bounded, slices
from ..functions.dlp import BUILT_IN, DEFAULT_RULES, MAX_RULES, NAMES, Rule, Scanner
from .security import upsert


#: Characters of terms in one automaton; random words took 42 bytes for each.
PART_CHARS = 1 << 21
#: Terms of one or two characters that are looked for one by one; more of them go into the automaton too.
_SHORT_TERMS = 128
_RESULT = f"struct<findings:array<{dlp.FINDING}>,masked_text:string>"


def scan_and_mask(rows: DataFrame, text: str, location: str, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """rows with findings, masked_text, masked_entities, risk_level, blocked and location.

    A null text has no findings and stays null.
    """
    chosen = dlp.detectors(rules)

    @F.arrow_udf(_RESULT)
    def scan(texts: pa.Array) -> pa.Array:
        scanner = Scanner(chosen)
        parts = [dlp.scan_texts(scanner, texts.slice(at, n).to_pylist()) for at, n in slices(texts)]
        return pa.concat_arrays(parts) if parts else dlp.scan_texts(scanner, [])

    return _masked(rows.withColumn("_scan", scan(text)), location)


def scan_with_dictionary(rows: DataFrame, text: str, location: str, dictionary: DataFrame) -> DataFrame:
    """``scan_and_mask`` with the active rules of a dictionary of any size, newest first.

    The rules that occur in a text are found by ``dictionary_hits`` and join it as an array; only they are run.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("age"), "entity_type", "value", "replacement", "risk_level")))
    own = dictionary_hits(rows, text, dictionary).groupBy("text_hash").agg(ordered.alias("_rules")).withColumnRenamed("text_hash", "_text_hash")
    found = rows.withColumn("_text_hash", F.xxhash64(text)).join(own, "_text_hash", "left").drop("_text_hash")

    @F.arrow_udf(_RESULT)
    def scan(texts: pa.Array, rules: pa.Array) -> pa.Array:
        scanner, parts = Scanner([*BUILT_IN, *NAMES]), []
        for at, n in slices(texts):
            named = [[Rule(r["entity_type"], r["value"], r["replacement"], r["risk_level"]) for r in some or ()] for some in rules.slice(at, n).to_pylist()]
            parts.append(dlp.scan_texts(scanner, texts.slice(at, n).to_pylist(), named, len(BUILT_IN)))
        return pa.concat_arrays(parts) if parts else dlp.scan_texts(scanner, [])

    return _masked(found.withColumn("_scan", scan(text, "_rules")).drop("_rules"), location)


def dictionary_hits(rows: DataFrame, text: str, dictionary: DataFrame) -> DataFrame:
    """(text_hash, rule columns): the active rules whose value may occur in a text, in any case, once each.

    Rules may be too many by what ``folded`` takes for equal, never too few. A text's terms stay one array until copies of
    texts are gone.
    """
    terms = _terms(dictionary)
    found = _found(rows, F.xxhash64(text).alias("text_hash"), text, terms.withColumn("label", F.col("term")))
    one = [part.dropDuplicates(["text_hash"]).select("text_hash", F.explode("found").alias("term")) for part in found]
    return reduce(DataFrame.unionByName, one).join(terms, "term").drop("term")


def dictionary_values(rows: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(key, found): the different values of the active rules that ``dictionary_hits`` finds in each row's text, in order.

    ``key`` tells rows apart; rows whose text is null or holds nothing are left out. Nothing is shuffled for a dictionary of one part.
    """
    parts = _found(rows, F.col(key), text, _terms(dictionary).withColumn("label", F.col("value")))
    if len(parts) == 1:
        return parts[0]
    whole = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.flatten(F.collect_list("found")).alias("found"))
    return whole.withColumn("found", F.sort_array(F.array_distinct("found")))


def _terms(dictionary: DataFrame) -> DataFrame:
    return dictionary.where("is_active and value != ''").select("entity_type", "value", "replacement", "risk_level", "created_at").withColumn("term", dlp.folded(F.col("value")))


def _found(rows: DataFrame, key: Column, text: str, terms: DataFrame) -> list[DataFrame]:
    """For each part of terms (term, label): (key, found), the labels of the terms in a text, different and in order, of rows with any.

    Terms are dealt to parts by their first characters, and a part's terms are a ``Terms``, so the cost of a text depends
    neither on how long terms are nor on how many a part has. A dictionary of several parts is that many passes.
    """
    spark = rows.sparkSession
    folded = rows.where(F.col(text).isNotNull()).select(key, dlp.folded(F.col(text)).alias("said"))
    name, kind = folded.columns[0], folded.schema[0].dataType.simpleString()
    out = []
    for part in _parts(terms):
        table = part.select("term", "label").distinct().toArrow()  # bounded: about PART_CHARS
        sent = spark.sparkContext.broadcast((table.column("term").to_pylist(), table.column("label").to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            known = Terms(*sent.value)
            labels = pa.array(known.labels, pa.string())
            for b in bounded(batches, "said") if known.labels else ():
                hits = [known.of(s) for s in b.column("said").to_pylist()]
                ends = np.cumsum([0, *(len(h) for h in hits)])
                numbers = np.fromiter(chain.from_iterable(hits), np.int32, ends[-1])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), labels.take(pa.array(numbers)))
                some = pa.array(np.diff(ends) > 0)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(some), lists.filter(some)], [name, "found"])

        out.append(folded.mapInArrow(run, f"`{name}` {kind}, found array<string>"))
    return out


class Terms:
    """Terms and their labels; ``of`` a text gives the numbers of the labels, in order, whose term it holds.

    An automaton reports every place a term stands at. Terms of one or two characters stand at most places, so if they
    are few each is looked for by itself instead, up to its first place.
    """

    def __init__(self, terms: Sequence[str], labels: Sequence[str]):
        self.labels = sorted(set(labels))
        number = {label: n for n, label in enumerate(self.labels)}
        own: dict[str, list[int]] = {}
        for term, label in sorted(zip(terms, labels, strict=True), key=itemgetter(1)):
            own.setdefault(term, []).append(number[label])
        self._own = list(own.values())
        self._alone = self._own == [[n] for n in range(len(own))]  # numbers of terms are those of labels
        short = [(n, term) for n, term in enumerate(own) if len(term) <= 2]
        self._short = short if len(short) <= _SHORT_TERMS else []
        alone = {n for n, _ in self._short}
        self._long = _automaton((n, term) for n, term in enumerate(own) if n not in alone)

    def of(self, text: str) -> list[int]:
        hits = set(map(itemgetter(1), self._long.iter(text))) if len(self._long) else set()  # without terms it can't be searched
        hits.update(n for n, term in self._short if term in text)
        return sorted(hits if self._alone else {label for n in hits for label in self._own[n]})


def _parts(terms: DataFrame) -> list[DataFrame]:
    """terms in parts of about PART_CHARS characters: whole first characters together, a crowded one dealt by hash."""
    begin = F.substring("term", 1, 1)
    sizes = terms.groupBy(begin.alias("begin")).agg(F.sum(F.length("term")).alias("n")).orderBy("begin").collect()  # one row a character
    parts: list[DataFrame] = []
    held: list[str] = []
    room = PART_CHARS
    for r in sizes:
        if r.n > PART_CHARS:
            k = -(-r.n // PART_CHARS)
            parts += [terms.where((begin == r.begin) & (F.pmod(F.xxhash64("term"), F.lit(k)) == i)) for i in range(k)]
            continue
        if r.n > room:
            parts.append(terms.where(begin.isin(*held)))
            held, room = [], PART_CHARS
        held.append(r.begin)
        room -= r.n
    return [*parts, terms.where(begin.isin(*held))] if held or not parts else parts


def _automaton(terms: Iterable[tuple[int, str]]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for n, term in terms:
        made.add_word(term, n)
    made.make_automaton()
    return made


def _masked(scanned: DataFrame, location: str) -> DataFrame:
    f = F.col("findings")
    return (
        scanned.withColumn("findings", F.col("_scan.findings"))
        .withColumn("masked_text", F.col("_scan.masked_text"))
        .drop("_scan")
        .withColumn("masked_entities", dlp.entities(f))
        .withColumn("risk_level", dlp.highest_risk(f))
        .withColumn("blocked", dlp.is_blocked(f))
        .withColumn("location", F.lit(location))
    )


def masking_events(scanned: DataFrame, message_id: str) -> DataFrame:
    """One row per finding of scanned rows; the value itself is not recorded."""
    one = scanned.select(F.col(message_id).alias("message_id"), "location", F.posexplode("findings").alias("nth", "f"))
    return one.select(
        "message_id",
        "nth",
        F.col("f.entity_type").alias("entity_type"),
        F.lit(None).cast("string").alias("original_value"),
        dlp.replacement(F.col("f")).alias("masked_value"),
        F.col("f.action").alias("masking_method"),
        F.col("f.confidence").alias("confidence"),
        F.col("f.risk_level").alias("risk_level"),
        "location",
    )


def active_rules(dictionary: DataFrame) -> list[Rule]:
    """Active rules, newest first, as a list. More than MAX_RULES are an error: ``scan_with_dictionary`` takes them as a table."""
    wanted = dictionary.where("is_active").orderBy(F.col("created_at").desc_nulls_first(), "entity_type", "value").limit(MAX_RULES + 1)
    rows = wanted.select("entity_type", "value", "replacement", "risk_level").collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} active rules")
    return [Rule(r.entity_type, r.value, r.replacement, r.risk_level) for r in rows]


def upsert_rules(dictionary: DataFrame, changes: DataFrame) -> DataFrame:
    """Rules are keyed by type and value, case and all; an update keeps the rule's creation time."""
    born = dictionary.select("entity_type", "value", F.col("created_at").alias("_born"))
    dated = changes.join(born, ["entity_type", "value"], "left").withColumn("created_at", F.coalesce("_born", "created_at")).drop("_born")
    return upsert(dictionary, dated, ["entity_type", "value"])


def toggle_rule(dictionary: DataFrame, entity_type: str, value: str, is_active: bool) -> DataFrame:
    hit = (F.col("entity_type") == entity_type) & (F.col("value") == value)
    return dictionary.withColumn("is_active", F.when(hit, F.lit(is_active)).otherwise(F.col("is_active")))


def install_templates(dictionary: DataFrame, created_at) -> DataFrame:
    """The default rules, inactive; installing again makes them inactive again."""
    spark = dictionary.sparkSession
    rows = [(r.entity_type, r.value, r.replacement, r.risk_level, False) for r in DEFAULT_RULES]
    templates = spark.createDataFrame(rows, "entity_type string, value string, replacement string, risk_level string, is_active boolean")
    return upsert_rules(dictionary, templates.withColumn("created_at", F.lit(created_at).cast("timestamp_ntz")))
