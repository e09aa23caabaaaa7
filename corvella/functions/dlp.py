"""Sensitive data: detectors, overlap removal and masking, as array expressions and as a scanner over Arrow batches.

A finding is a struct; a text's findings are an array of them in text order. Offsets count code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FINDING = "struct<start:int,shorter:int,detector:int,end:int,entity_type:string,value:string,action:string,risk_level:string,confidence:double,replacement:string>"
RISKS = ("low", "medium", "high")


@dataclass(frozen=True)
class Detector:
    """A pattern and what becomes of its matches. ``hint``: a cheap necessary test of the lower-cased text."""

    entity_type: str
    pattern: str
    action: str = "mask"
    risk_level: str = "low"
    confidence: float = 1.0
    replacement: str | None = None
    hint: tuple[str, ...] = ()


# The detectors in their order, which breaks ties. (?U) gives the classes their Unicode meaning.
BUILT_IN: tuple[Detector, ...] = (
    Detector("email", r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", hint=("@",)),
    Detector("phone_number", r"(?U)\b(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{2,4}\)?[-.\s]?)?\d{3,4}[-.\s]?\d{4}\b"),
    Detector("ip_address", r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b", hint=(".",)),
    Detector("api_key", r"(?U)\b(?:sk|pk|rk)-[A-Za-z0-9_-]{16,}\b", "redact", "high", hint=("sk-", "pk-", "rk-")),
    Detector("secret", r"(?iU)\b(?:password|token|secret)\s*[:=]\s*\S+", "redact", "high"),
    Detector("url", r"(?iU)https?://[^\s]+", hint=("://",)),
    Detector("file_path", r"(?U)(?:[A-Za-z]:\\|/)[^\s]+", risk_level="medium", hint=("/", "\\")),
    Detector("lot_number", r"(?iU)\b(?:lot|batch)[-_:\s]*[A-Z0-9-]{4,}\b", risk_level="medium", hint=("lot", "batch")),
    Detector("machine_name", r"(?iU)\b(?:machine|tool|eqp)[-_:\s]*[A-Z0-9-]{3,}\b", risk_level="medium", hint=("machine", "tool", "eqp")),
    Detector("process_parameter", r"(?iU)\b(?:temperature|temp|pressure|voltage|current|rpm)\s*[:=]\s*[-+]?\d+(?:\.\d+)?\s*[A-Za-z%/]*", risk_level="medium", hint=(":", "=")),
    Detector("customer_code", r"(?iU)\b(?:customer|cust)[-_:\s]*[A-Z0-9-]{3,}\b", risk_level="medium"),
    Detector("product_code", r"(?iU)\b(?:product|prod|model)[-_:\s]*[A-Z0-9-]{3,}\b", risk_level="medium", hint=("prod", "model")),
)
NAMES: tuple[Detector, ...] = (
    Detector("person_name", r"(?U)\b(?:name|owner|contact)\s*[:=]\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}\b", risk_level="medium", confidence=0.7, hint=("name", "owner", "contact")),
    Detector("organization", r"(?U)\b[A-Z][A-Za-z0-9&.-]+(?:\s+[A-Z][A-Za-z0-9&.-]+){0,3}\s+(?:Inc|Corp|Co|Ltd|LLC)\b", risk_level="medium", confidence=0.7, hint=("inc", "co", "ltd", "llc")),
)


@dataclass(frozen=True)
class Rule:
    """A dictionary entry: every occurrence of ``value``, in any case."""

    entity_type: str
    value: str
    replacement: str | None = None
    risk_level: str = "medium"
    is_active: bool = True

    def detector(self) -> Detector:
        put = self.replacement or f"[{self.entity_type.upper()}]"
        literal = "\\Q" + self.value.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        return Detector(self.entity_type, "(?iU)" + literal, "block" if put == "[BLOCK]" else "mask", self.risk_level, 1.0, put)


# The rules that hold where no dictionary is given.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("restricted_keyword", "RESTRICTED_FORMULA", "[BLOCK]", "high"),
    Rule("customer_name", "Example Customer Corp", "[CUSTOMER_001]", "medium"),
    Rule("machine_name", "Machine-A12", "[MACHINE_001]", "medium"),
)
#: Rules given as a list are expressions of their own in the plan, so many at most. A dictionary of any size is
#: a table: see ``operators.dlp.scan_with_dictionary``.
MAX_RULES = 500


def detectors(rules: Sequence[Rule] = DEFAULT_RULES) -> list[Detector]:
    """Built-in patterns, then active rules with a value, then names."""
    active = [r.detector() for r in rules if r.is_active and r.value]
    if len(active) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} dictionary rules")
    return [*BUILT_IN, *active, *NAMES]


def _none() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def _spans(text: Column, pattern: Column, made: Callable[[Column, Column], Column]) -> Column:
    """All matches of a pattern, as made(start, value). What stands between the matches gives their offsets."""
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))
    reach = lambda done: F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(0))
    return F.aggregate(pairs, _none(), lambda done, p: F.concat(done, F.array(made(reach(done) + p["gap"], p["hit"]).cast(FINDING))))


def _finding(start: Column, value: Column, place: Column, entity_type: Column, action: Column, risk_level: Column, confidence: Column, put: Column) -> Column:
    return F.struct(
        start.alias("start"),
        (-F.length(value)).alias("shorter"),
        place.alias("detector"),
        (start + F.length(value)).alias("end"),
        entity_type.alias("entity_type"),
        value.alias("value"),
        action.alias("action"),
        risk_level.alias("risk_level"),
        confidence.alias("confidence"),
        put.alias("replacement"),
    )


def _found(text: Column, d: Detector, place: Column) -> Column:
    """All matches of one detector."""
    might = text.rlike(d.pattern)
    if d.hint:
        lowered = F.lower(text)
        cheap = lowered.contains(d.hint[0])
        for h in d.hint[1:]:
            cheap = cheap | lowered.contains(h)
        might = cheap & might
    made = lambda start, value: _finding(start, value, place, *map(F.lit, (d.entity_type, d.action, d.risk_level, d.confidence)), F.lit(d.replacement).cast("string"))
    return F.when(might, _spans(text, F.lit(d.pattern), made)).otherwise(_none())


def folded(text: Column) -> Column:
    """Texts that the rules' patterns hold alike in another case become equal (so do a few others: ligatures and their letters)."""
    # A search each: translate() makes an object of every character. ß has no upper case of one character and is put aside.
    for a, b in (("\u1e9e", "\ue0df"), ("ß", "\ue0df"), ("İ", "i"), ("ı", "i")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.replace(F.lower(F.upper(text)), F.lit("ς"), F.lit("σ"))


def detect(text: Column, chosen: Sequence[Detector]) -> Column:
    """Every match of every detector, by start, then the longer, then the earlier detector. Null text: none."""
    return F.array_sort(F.concat(*(_found(F.coalesce(text, F.lit("")), d, F.lit(i)) for i, d in enumerate(chosen))))


def without_overlaps(findings: Column) -> Column:
    """Of sorted findings each that starts where all accepted ones have ended."""
    reach = lambda done: F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(0))
    return F.aggregate(findings, _none(), lambda done, f: F.when(f["start"] >= reach(done), F.concat(done, F.array(f))).otherwise(done))


def replacement(finding: Column) -> Column:
    kind = F.when(finding["action"] == "redact", "[REDACTED]").when(finding["action"] == "block", "[BLOCKED]")
    return F.coalesce(F.nullif(finding["replacement"], F.lit("")), kind.otherwise(F.concat(F.lit("["), F.upper(finding["entity_type"]), F.lit("]"))))


def masked(text: Column, findings: Column) -> Column:
    """The text with every finding replaced; findings don't overlap."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, f: F.struct(f["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, f["start"] - acc["at"]), replacement(f)).alias("out"))
    return F.when(F.size(findings) == 0, text).otherwise(F.aggregate(findings, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))


def entities(findings: Column) -> Column:
    return F.transform(findings, lambda f: F.struct(f["entity_type"].alias("entity_type"), replacement(f).alias("masked_value")))


def highest_risk(findings: Column) -> Column:
    """The highest level found; low where nothing is. Unknown levels rank below all."""
    names = F.array(*map(F.lit, RISKS))
    rank = F.array_max(F.transform(findings, lambda f: F.array_position(names, f["risk_level"])))
    return F.coalesce(F.get(names, (rank - 1).cast("int")), F.lit("low"))


def is_blocked(findings: Column) -> Column:
    return F.exists(findings, lambda f: f["action"] == "block")


def python_pattern(d: Detector) -> re.Pattern:
    """The same pattern for re, whose classes are Unicode by default."""
    flags, body = re.match(r"\(\?(\w+)\)(.*)", d.pattern, re.S).groups()
    literal = re.fullmatch(r"\\Q(.*)\\E", body, re.S)
    return re.compile(re.escape(literal[1].replace("\\E\\\\E\\Q", "\\E")) if literal else body, re.I if "i" in flags else 0)


class Scanner:
    """All detectors over one text after another, each pattern once.

    ``spans`` gives (start, end, detector, its number) of what is left of all matches by start, then the longer, then the
    earlier detector, when each must start where those before it have ended.
    """

    def __init__(self, chosen: Sequence[Detector]):
        self.chosen = list(chosen)
        self.patterns = [python_pattern(d) for d in self.chosen]

    def spans(self, text: str, more: Sequence[tuple[Detector, re.Pattern]] = (), place: int = 0) -> list[tuple[int, int, Detector, int]]:
        """``more``: detectors of this text alone, which stand before number ``place`` in the order."""
        lowered = text.lower()
        found: list[tuple[int, int, int]] = []
        chosen = [*self.chosen[:place], *(d for d, _ in more), *self.chosen[place:]] if more else self.chosen
        patterns = [*self.patterns[:place], *(p for _, p in more), *self.patterns[place:]] if more else self.patterns
        for nth, (d, pattern) in enumerate(zip(chosen, patterns, strict=True)):
            if not d.hint or any(h in lowered for h in d.hint):
                found += [(m.start(), -m.end(), nth) for m in pattern.finditer(text)]
        found.sort()
        kept, reach = [], 0
        for start, end, nth in found:
            if start >= reach:
                kept.append((start, -end, chosen[nth], nth))
                reach = -end
        return kept


def replaced_by(d: Detector) -> str:
    return d.replacement or {"redact": "[REDACTED]", "block": "[BLOCKED]"}.get(d.action, f"[{d.entity_type.upper()}]")


def scan_texts(scanner: Scanner, texts: Sequence[str | None], rules: Sequence[Sequence[Rule]] | None = None, place: int = 0) -> pa.StructArray:
    """struct(findings, masked_text) of every text; null stays null and has no findings."""
    fields: dict[str, list] = {f.split(":")[0]: [] for f in FINDING[7:-1].split(",")}
    offsets, masked_texts = [0], []
    compiled: dict[Rule, tuple[Detector, re.Pattern]] = {}
    for k, text in enumerate(texts):
        more = []
        for rule in rules[k] if rules is not None and rules[k] else ():
            if rule not in compiled:
                if len(compiled) > 20_000:
                    compiled.clear()
                compiled[rule] = (rule.detector(), re.compile(re.escape(rule.value), re.I))
            more.append(compiled[rule])
        kept = scanner.spans(text, more, place) if text else []
        out, at = [], 0
        for start, end, d, nth in kept:
            for name, value in (("start", start), ("shorter", start - end), ("detector", nth), ("end", end), ("entity_type", d.entity_type), ("value", text[start:end]), ("action", d.action), ("risk_level", d.risk_level), ("confidence", d.confidence), ("replacement", d.replacement)):
                fields[name].append(value)
            out += (text[at:start], replaced_by(d))
            at = end
        offsets.append(offsets[-1] + len(kept))
        masked_texts.append("".join(out) + text[at:] if kept else text)
    kinds = {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    columns = [pa.array(fields[name], kinds[kind]) for name, kind in (f.split(":") for f in FINDING[7:-1].split(","))]
    findings = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, list(fields)))
    return pa.StructArray.from_arrays([findings, pa.array(masked_texts, pa.string())], ["findings", "masked_text"])
