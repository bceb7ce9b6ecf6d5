"""Personal data by weak supervision.

Patterns name the base spans, and wider patterns further candidates. Labelers (pattern, gazetteer, context, validity)
vote on every candidate or abstain; expectation-maximisation over the counts of vote patterns, of which there are at
most 3 ** labelers, estimates how reliable each is; the posteriors train a naive Bayes classifier over span features of
bounded number, which decides on the candidates that are not base. DataFrame functions only, on whole texts.

Places are code points. The pieces between matches give the places, so that each text is passed over a fixed number of
times. Null and empty texts have no spans. Repeated rows are searched each for itself. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let
from .weak import Accuracies

KINDS = ["email", "ip", "card", "phone", "id", "name"]

#: base patterns; runs are taken whole where giving characters back cannot lead to a match
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: further candidates
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]++(?: ?(?:[(\[] ?dot ?[)\]]|\.) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+().-])(?<![0-9+)] )(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<!\p{L})(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.? \p{Lu}\p{Ll}+",
}
#: a text without any of these characters or strings has no match, and is not searched
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
WIDE_NEEDS = {"email": "at", "phone": "", "id": "-", "name": ""}

CUES = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse|direcci",
    "card": "card|visa|karte|carte|tarjeta|credit",
    "phone": "tel|phone|call|fax|mobile|handy|rufen|llam|appel",
    "id": "ssn|social|passport|ausweis|dni",
    "name": "dear|liebe|cher|estimad|signed|regards",
}
AGAINST = "version|isbn|issn|doi|page|chapter|invoice|order|total|build|release"
DOMAINS = "com|org|net|edu|gov|de|fr|es|uk|io|info|eu"
LABELERS = ["by_pattern", "by_gazetteer", "by_context", "by_validity"]
CONTEXT = 40
CANDIDATES = ("array<struct<kind:int,start:bigint,stop:bigint,base:boolean,by_pattern:int,by_gazetteer:int,"
              "by_context:int,by_validity:int,features:array<string>>>")
CERTAIN = 0.9


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    def term(i: Column) -> Column:
        x = F.substring(number, F.char_length(number) - i, F.lit(1)).cast("int")
        doubled = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return F.when(i % 2 == 1, doubled).otherwise(x)

    places = F.sequence(F.lit(0), F.char_length(number) - 1)
    return F.aggregate(F.transform(places, term), F.lit(0), lambda total, x: total + x) % 10 == 0


OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"


def holds(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "card":
        return F.when(F.char_length(digits(value)).between(16, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.char_length(digits(value)).between(8, 15)
    return F.lit(True)


def prefix_sums(values: Column, width: int = 64) -> Column:
    """The sum of all values before each; summed by blocks, so that very many values do not cost their square."""
    add = lambda total, x: total + x

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), add)

    def of(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int"))

        def inside(before: Column) -> Column:
            return F.transform(v, lambda x, i: F.get(before, F.floor(i / width).cast("int")) + total(
                F.slice(v, F.floor(i / width).cast("int") * width + 1, i % width)))

        def over(sums: Column) -> Column:
            return let(F.transform(sums, lambda s, i: total(F.slice(sums, F.lit(1), i))), inside)

        return let(F.transform(blocks, lambda b: total(F.slice(v, b * width + 1, F.lit(width)))), over)

    return F.when(F.size(values) > 0, let(values, of)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, need: str, describe: Callable[[Column], Column], kind: int) -> Column:
    """The non-overlapping matches as described structs; `describe` gets kind, place, value and what stands around."""
    def found(values: Column) -> Column:
        def cut(pieces: Column) -> Column:
            lengths = F.transform(values, lambda v, i: F.char_length(F.get(pieces, i)) + F.char_length(v))

            def placed(before: Column) -> Column:
                return F.transform(values, lambda v, i: let(F.struct(
                    F.lit(kind).alias("kind"), (F.get(before, i) + F.char_length(F.get(pieces, i))).alias("start"),
                    v.alias("value"), F.right(F.get(pieces, i), F.lit(CONTEXT)).alias("before"),
                    F.left(F.get(pieces, i + 1), F.lit(1)).alias("after")), describe))

            return let(prefix_sums(lengths), placed)

        return let(F.split(text, pattern, -1), cut)

    none = F.array().cast(CANDIDATES)
    all_values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    some = let(all_values, lambda v: F.when(F.size(v) > 0, found(v)).otherwise(none))
    ready = F.contains(text, F.lit(need)) if need else text.rlike("[0-9]" if KINDS[kind] != "name" else pattern)
    return F.when(ready, some).otherwise(none)


def bucket(value: Column, *bounds: int) -> Column:
    out = F.lit(0)
    for bound in bounds:
        out = out + (value >= bound).cast("int")
    return out.cast("string")


def description(kind: str, base: bool) -> Callable[[Column], Column]:
    """A candidate with its votes and features."""
    def describe(m: Column) -> Column:
        value, before, after = m["value"], F.lower(m["before"]), m["after"]
        number = F.char_length(digits(value))
        is_base = holds(kind, value) if base else F.lit(False)
        cue, against = before.rlike(CUES[kind]), before.rlike(AGAINST)
        glued = before.rlike(r"[\p{L}\p{N}]$") | after.rlike(r"^[\p{L}\p{N}]")
        vote = lambda yes, no: F.when(no, -1).when(yes, 1).otherwise(0)
        never = F.lit(False)
        valid = {
            "email": vote(F.lower(value).rlike(rf"(\.|dot ?[)\]] ?)({DOMAINS})$"), never),
            "ip": vote(is_base & ~value.rlike(r"^0|^2[4-9]"), ~is_base),
            "card": vote(is_base, ~is_base),
            "phone": vote(number.between(9, 15), (number < 8) | (number > 15)),
            "id": vote(~value.rlike("^(000|666|9)"), value.rlike("^(000|666|9)")),
            "name": vote(never, never),
        }[kind]
        features = {
            "kind": F.lit(kind), "length": bucket(F.char_length(value), 8, 12, 16, 24), "digits": bucket(number, 1, 8, 12, 16),
            "cue": cue.cast("string"), "against": against.cast("string"), "glued": glued.cast("string"),
            "parts": bucket(F.size(F.split(value, r"[\x20.()-]+")), 2, 3, 4, 6),
        }
        return F.struct(
            m["kind"].alias("kind"), m["start"].cast("long").alias("start"),
            (m["start"] + F.char_length(value)).cast("long").alias("stop"), is_base.alias("base"),
            vote(is_base, ~is_base if base else never).alias("by_pattern"), vote(cue, against).alias("by_gazetteer"),
            vote(~glued, glued).alias("by_context"), valid.alias("by_validity"),
            F.array(*[F.concat(F.lit(f"{name}="), v) for name, v in features.items()]).alias("features"))

    return describe


def candidates(text: Column) -> Column:
    """All candidates of a text, in order of kind."""
    parts = [matches(text, pattern, NEEDS[kind], description(kind, True), KINDS.index(kind)) for kind, pattern in BASE.items()]
    parts += [matches(text, pattern, WIDE_NEEDS[kind], description(kind, False), KINDS.index(kind))
              for kind, pattern in WIDE.items()]
    return F.concat(*parts)


def classifier(voted: DataFrame, found: Accuracies) -> Callable[[Column], Column]:
    """Naive Bayes on the features of exploded candidates `c`, with the posteriors as soft labels."""
    soft = voted.select(found.posterior().alias("p"), "c.features")
    rows = soft.select(F.explode("features").alias("feature"), "p").groupBy("feature").agg(
        F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    total = [sum(r[x] for r in rows if r["feature"].startswith("kind=")) for x in ("yes", "no")]
    bias = math.log((total[0] + 1) / (total[1] + 1))
    weights = {r["feature"]: round(math.log((r["yes"] + 1) / (total[0] + 2) * (total[1] + 2) / (r["no"] + 1)), 6)
               for r in sorted(rows)}

    def probability(features: Column) -> Column:
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.lit(None).cast("map<string,double>")
        odds = F.aggregate(features, F.lit(round(bias, 6)), lambda s, x: s + F.coalesce(F.try_element_at(table, x), F.lit(0.0)))
        return 1 / (1 + F.exp(-odds))

    return probability


def find(docs: DataFrame, rounds: int = 30) -> DataFrame:
    """doc_id and `spans` of each row, an array of (kind, start, stop, base) by kind as listed, then start.

    The candidates are written once; they are few, and all that follows reads them instead of the texts.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = scratch.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", candidates(F.col("text")).alias("found")), "candidates")
    voted = held.select(F.explode("found").alias("c")).select("c", *[f"c.{x}" for x in LABELERS])
    patterns = scratch.write(voted.groupBy(*LABELERS).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    accuracies = Accuracies(LABELERS, prior=0.5)
    for _ in range(rounds):
        if accuracies.refit(patterns) < 1e-5:
            break
    probability = classifier(voted, accuracies)
    base = F.filter("found", lambda c: c["base"])
    free = lambda c: ~F.exists("sure", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
    split = held.select("doc_id", base.alias("sure"), F.filter("found", lambda c: ~c["base"]).alias("other"))
    added = F.filter("other", lambda c: (probability(c["features"]) >= CERTAIN) & free(c))
    short = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"), c["base"].alias("base"))
    return split.select("doc_id", F.array_sort(F.concat(F.transform("sure", short), F.transform(added, short))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
