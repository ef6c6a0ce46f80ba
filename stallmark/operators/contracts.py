"""Contracts of JSON documents: one declaration gives the typed value, the reasons against it, and the keys it does not know.

Documents are VARIANT columns, so numbers, text, booleans and nulls are told apart as the JSON has them. A document with
any reason has no value; unknown keys are no reason and are left out of the value.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallmark.functions.text import made_once, once
from stallmark.operators.scoring import verdict
from stallmark.schema import VERDICTS

KINDS = {"string": "string", "number": "double", "integer": "long", "boolean": "boolean", "strings": "array<string>", "object": "variant"}


@dataclass(frozen=True)
class Rule:
    """A key of a document. least and most bound numbers (above: itself out), the size of text after trimming (trimmed), or
    of each text of strings; items bounds their count."""

    name: str
    kind: str
    nullable: bool = False
    among: tuple[str, ...] = ()
    least: float | None = None
    most: float | None = None
    above: float | None = None
    trimmed: bool = False
    items: int | None = None

    def value(self, document: Column) -> Column:
        v = F.try_variant_get(document, f"$.{self.name}", KINDS[self.kind])
        if self.trimmed:
            return F.transform(v, strip) if self.kind == "strings" else strip(v)
        return v

    def _fits(self, document: Column) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(document, f"$.{self.name}", "variant"))
        number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        v = F.try_variant_get(document, f"$.{self.name}", "double")
        texts = F.forall(F.try_variant_get(document, f"$.{self.name}", "array<variant>"), lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
        return {"string": kind == "STRING", "number": number, "integer": number & (v == F.floor(v)), "boolean": kind == "BOOLEAN", "strings": kind.startswith("ARRAY") & F.coalesce(texts, F.lit(False)), "object": kind.startswith("OBJECT")}[self.kind]

    def reasons(self, document: Column) -> Column:
        """What is wrong with this key, first things first: an array."""
        held = F.try_variant_get(document, f"$.{self.name}", "variant")
        void, v = F.schema_of_variant(held) == "VOID", self.value(document)
        say = lambda bad, what: F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{self.name}: {what}"))
        size = units(v) if self.kind == "string" else v
        checks = []
        if self.among:
            checks.append(say(~v.isin(*self.among), "not one of " + ", ".join(self.among)))
        if self.kind == "strings":
            if self.least is not None:
                checks.append(say(F.exists(v, lambda x: units(x) < self.least), f"holds less than {self.least:g}"))
            if self.most is not None:
                checks.append(say(F.exists(v, lambda x: units(x) > self.most), f"holds more than {self.most:g}"))
            if self.items is not None:
                checks.append(say(F.size(v) > self.items, f"more than {self.items} items"))
        else:
            if self.least is not None:
                checks.append(say(size < self.least, f"less than {self.least:g}"))
            if self.above is not None:
                checks.append(say(size <= self.above, f"not above {self.above:g}"))
            if self.most is not None:
                checks.append(say(size > self.most, f"more than {self.most:g}"))
        found = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
        wrong = F.when(~self._fits(document), F.array(F.lit(f"{self.name}: not {self.kind}"))).otherwise(found)
        null = F.array().cast("array<string>") if self.nullable else F.array(F.lit(f"{self.name}: null"))
        return F.when(held.isNull(), F.array(F.lit(f"{self.name}: missing"))).when(void, null).otherwise(wrong)


@dataclass(frozen=True)
class Contract:
    name: str
    rules: tuple[Rule, ...]

    def reasons(self, document: Column) -> Column:
        every = reduce(F.concat, (r.reasons(document) for r in self.rules))
        return F.when(is_object(document), every).otherwise(F.array(F.lit("not an object")))

    def value(self, document: Column) -> Column:
        return F.struct(*(r.value(document).alias(r.name) for r in self.rules))

    def unknown(self, document: Column) -> Column:
        return F.array_sort(F.array_except(F.map_keys(record(document)), F.array(*(F.lit(r.name) for r in self.rules))))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def units(text: Column) -> Column:
    """The length of a text in UTF-16 units."""
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def is_object(document: Column) -> Column:
    return F.coalesce(F.schema_of_variant(document).startswith("OBJECT"), F.lit(False))


def record(document: Column) -> Column:
    """A JSON object as a map; anything else is an empty one."""
    return F.when(is_object(document), F.try_variant_get(document, "$", "map<string,variant>")).otherwise(F.create_map().cast("map<string,variant>"))


def checked(df: DataFrame, document: str, contract: Contract) -> DataFrame:
    """Rows with the reasons against their JSON text `document`, its value and its unknown_keys. A text is parsed once, and as a
    generator gives the three, no filter on them is moved below and works them out again."""
    facts = lambda d: F.struct(contract.reasons(d).alias("reasons"), contract.value(d).alias("value"), contract.unknown(d).alias("unknown_keys"))
    return df.select("*", F.inline(F.array(once(F.try_parse_json(F.col(document)), facts))))


def held_to(df: DataFrame, document: str, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): rows whose JSON text `document` keeps the contract, with `value` and `unknown_keys`, and the other
    rows with `reasons`. Text that is no JSON, or null, is rejected."""
    rows = checked(df, document, contract)
    return rows.where(F.size("reasons") == 0).drop("reasons"), rows.where(F.size("reasons") > 0).drop("value", "unknown_keys")


def _snake(name: str) -> str:
    return re.sub("([A-Z])", lambda m: f"_{m[1].lower()}", name)


def gate_extractions(df: DataFrame, data: str, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(good, rejected with reasons): extractions (a struct column `data`, keys in snake case) whose numbers are within the
    contract's bounds and whose names are among its own, and those a store would refuse. Unknown values pass where the
    contract lets them be null."""
    fields = set(df.schema[data].dataType.names)
    checks = []
    for r in (r for r in contract.rules if _snake(r.name) in fields):
        v, say = F.col(data)[_snake(r.name)], lambda bad, what, r=r: F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{r.name}: {what}"))
        if r.kind in ("number", "integer"):
            checks += [say(v < r.least, f"less than {r.least:g}")] if r.least is not None else []
            checks += [say(v <= r.above, f"not above {r.above:g}")] if r.above is not None else []
            checks += [say(v > r.most, f"more than {r.most:g}")] if r.most is not None else []
        if r.among:
            checks.append(say(~v.isin(*r.among), "not one of " + ", ".join(r.among)))
        if not r.nullable:
            checks.append(say(v.isNull(), "null"))
    rows = df.withColumn("reasons", made_once(F.array_compact(F.array(*checks))))
    return rows.where(F.size("reasons") == 0).drop("reasons"), rows.where(F.size("reasons") > 0)


_text = lambda *names: tuple(Rule(n, "string", nullable=True) for n in names)
_said = lambda *names: tuple(Rule(n, "boolean") for n in names)
#: The documents' keys, kinds and bounds.
VEHICLE = Contract(
    "vehicle",
    (
        *_text("brand", "model", "version"),
        Rule("year", "integer", nullable=True, least=1900, most=2200),
        Rule("mileage", "integer", nullable=True, least=0),
        Rule("transmission", "string", among=("manual", "automatic", "cvt", "automated", "unknown")),
        Rule("fuel", "string", among=("gasoline", "ethanol", "flex", "diesel", "electric", "hybrid", "unknown")),
        *_said("maintenanceMentioned", "auctionMentioned", "sellerClaimsNoAuction", "accidentMentioned", "sellerClaimsNoAccident", "tradeAccepted", "financingAvailable"),
        Rule("condition", "string", among=("new", "used", "damaged", "unknown")),
    ),
)
GPU = Contract(
    "gpu",
    (
        Rule("gpuVendor", "string", nullable=True, among=("NVIDIA", "AMD", "Intel")),
        *_text("model", "normalizedModel", "boardBrand"),
        Rule("vramGb", "number", nullable=True, above=0),
        Rule("condition", "string", among=("new", "used", "refurbished", "damaged", "unknown")),
        *_text("usageTime", "warranty"),
        Rule("hasBox", "boolean", nullable=True),
        *_said("miningMentioned", "sellerClaimsNoMining"),
        Rule("defects", "strings"),
        *_said("repairsMentioned"),
    ),
)
NOTEBOOK = Contract(
    "notebook",
    (
        *_text("manufacturer", "model", "cpu"),
        Rule("cpuGeneration", "integer", nullable=True, above=0),
        *(Rule(n, "number", nullable=True, above=0) for n in ("ramGb", "storageGb")),
        Rule("storageType", "string", among=("ssd", "hdd", "unknown")),
        *_text("gpu"),
        Rule("screenInches", "number", nullable=True, above=0),
        *_text("resolution", "battery"),
        Rule("condition", "string", among=("new", "used", "damaged", "unknown")),
        Rule("defects", "strings"),
    ),
)
GENERIC = Contract("generic", (*_text("brand", "model"), Rule("condition", "string", among=("new", "used", "refurbished", "damaged", "unknown")), *_text("warranty"), Rule("defects", "strings"), Rule("features", "strings")))
EXTRACTED = Contract("extracted", (Rule("data", "object"), Rule("confidence", "number", least=0, most=1)))
DEAL_ANALYSIS = Contract(
    "deal_analysis",
    (
        Rule("score", "number", least=0, most=100),
        Rule("verdict", "string", among=tuple(VERDICTS)),
        *(Rule(n, "strings", least=1, most=500, trimmed=True, items=10) for n in ("advantages", "risks")),
        Rule("reason", "string", least=1, most=2000, trimmed=True),
    ),
)
BOOKKEEPING = ("extractionConfidence", "deterministicData", "deterministicExtractionConfidence", "extractionModel", "extractionAttemptModel", "extractionAttemptedAt", "sourceContentHash")


def contract_of(category: str) -> Contract:
    return {"vehicle": VEHICLE, "gpu": GPU, "notebook": NOTEBOOK}.get(category, GENERIC)


def _of_kind(v: Column, kind: str, to: str) -> Column:
    return F.when(F.schema_of_variant(v).rlike(kind), F.try_variant_get(v, "$", to))


def stored_extraction(document: Column) -> Column:
    """A stored document taken apart: the enriched and the deterministic fields as maps without bookkeeping (the enriched
    ones where nothing deterministic is stored), their confidences (0.5 where none is a number), models, time and hash."""
    stored = record(document)
    own = F.map_filter(stored, lambda k, _: ~k.isin(*BOOKKEEPING))
    theirs = F.map_filter(record(stored["deterministicData"]), lambda k, _: ~k.isin(*BOOKKEEPING))
    number, text = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "^STRING$"
    confidence = _of_kind(stored["extractionConfidence"], number, "double")
    sure = F.coalesce(_of_kind(stored["deterministicExtractionConfidence"], number, "double"), confidence, F.lit(0.5))
    return F.struct(
        own.alias("enriched"),
        F.coalesce(confidence, F.lit(0.5)).alias("confidence"),
        F.when(F.size(record(stored["deterministicData"])) > 0, theirs).otherwise(own).alias("deterministic"),
        sure.alias("deterministic_confidence"),
        *(_of_kind(stored[k], text, "string").alias(a) for k, a in (("extractionModel", "model"), ("extractionAttemptModel", "attempt_model"), ("sourceContentHash", "content_hash"))),
        _of_kind(stored["extractionAttemptedAt"], text, "string").try_cast("timestamp_ntz").alias("attempted_at"),
    )


def analysis_of_record(stored: DataFrame) -> DataFrame:
    """Stored analyses as a model gives them: the verdict follows from the score anew."""
    return stored.withColumn("verdict", verdict(F.col("score")))
