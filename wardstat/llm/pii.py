"""Personal data by patterns, checksums and context, in DataFrame operations only.

Patterns propose spans, checks confirm them (ranges of address parts, Luhn, mod 97, digit counts)
and words near a span move its score. The patterns below match exactly what their plain forms
match. They are written so that the matcher neither backtracks nor recurses over long runs:
quantifiers are possessive where nothing after them could need the characters back, and a run is
tried from its first character only (or from the end of the match before), since a later start
inside the same run can only succeed where the first one does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _any(match: Column) -> Column:
    return F.lit(True)


def address_parts(match: Column) -> Column:
    """Every part of a dotted address is at most 255."""
    return F.forall(F.split(match, "\\.", -1), lambda part: F.coalesce(part.try_cast("long") <= 255, F.lit(False)))


def luhn(match: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    digits = F.reverse(_digits(match))
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(digits, place, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(place % 2 == 0, doubled).otherwise(digit)

    right_length = F.length(digits).between(13, 19)
    return F.when(right_length, F.aggregate(places, F.lit(0), add) % 10 == 0).otherwise(False)


def phone_digits(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


def mod97(match: Column) -> Column:
    """15 to 34 characters that give 1 modulo 97 with the first four moved to the end."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(total: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        return F.when(code < 65, total * 10 + code - 48).otherwise(total * 100 + code - 55) % 97

    valid = F.aggregate(F.split(turned, ""), F.lit(0), lambda t, c: F.when(c == "", t).otherwise(add(t, c))) == 1
    return F.when(F.length(plain).between(15, 34), valid).otherwise(False)


@dataclass(frozen=True)
class Kind:
    name: str
    #: A character without which no match exists, tested before the pattern.
    needs: str
    pattern: str
    check: Callable[[Column], Column]
    #: Score of a confirmed span, and the words near it that raise or lower the score.
    score: float
    words: str
    against: str


#: The order is the order of the result. Base kinds keep every confirmed span; those after them are
#: added where the score reaches the limit.
BASE = [
    Kind("email", "[@]", "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", _any, 0.9, "mail|contact|write", "example"),
    Kind("ip", "[.]", "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", address_parts, 0.7, "ip|host|server|address|login", "version|release"),
    # Runs of fewer than 13 digits are never confirmed, so they are not proposed either.
    Kind("card", "[0-9]", "[0-9](?:[\\x20-]?[0-9]){12,}+", luhn, 0.8, "card|visa|master|credit|pay|amex", "isbn|order|serial"),
    Kind("phone", "[+]", "\\+[0-9][\\x20().0-9-]+[0-9]", phone_digits, 0.7, "phone|tel|call|mobile|fax|cell", "version|isbn"),
]
ADDED = [
    Kind("iban", "[0-9]", "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", mod97, 0.6, "iban|account|bank|transfer|konto", "serial|order"),
    Kind("ssn", "[-]", "(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", _any, 0.4, "ssn|social|security|insurance", "order|serial|part"),
]
#: Characters before and after a span in which words count as near.
NEAR = 48
#: What a near word adds or takes, and the score an added span needs.
STEP, LIMIT = 0.2, 0.5


#: Matches that are placed one after the other; their groups are placed as wholes.
GROUP = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: an expression named in a lambda is computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(pairs: Column, kind: Kind, near: int) -> Column:
    """Matches with the text around them as spans, by the lengths of all that comes before.

    A fold that appends copies its array at every step, so only groups of ``GROUP`` matches are folded,
    from the place that a fold over the groups gives them.
    """
    hits_type = "array<struct<kind:string,start:int,end:int,match:string,context:string>>"

    def length(pair: Column) -> Column:
        return F.length(pair["gap"]) + F.length(pair["match"])

    def advance(state: Column, pair: Column) -> Column:
        start = state["end"] + F.length(pair["gap"])
        end = state["end"] + length(pair)
        hit = F.struct(
            F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), pair["match"].alias("match"),
            F.lower(F.concat_ws(" ", F.right(pair["gap"], F.lit(near)), F.left(pair["after"], F.lit(near)))).alias("context"),
        )
        return F.struct(end.alias("end"), F.concat(state["hits"], F.array(hit)).alias("hits"))

    def within(group: Column) -> Column:
        start = F.struct(group["from"].alias("end"), F.array().cast(hits_type).alias("hits"))
        return F.aggregate(group["pairs"], start, advance, lambda state: state["hits"])

    def begin(state: Column, group: Column) -> Column:
        end = state["end"] + F.aggregate(group, F.lit(0), lambda total, pair: total + length(pair))
        return F.struct(end.alias("end"), F.concat(state["places"], F.array(state["end"])).alias("places"))

    def by_group(groups: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("places"))
        places = F.aggregate(groups, start, begin, lambda state: state["places"])
        return F.flatten(F.transform(F.arrays_zip(groups.alias("pairs"), places.alias("from")), within))

    def grouped(all_pairs: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(all_pairs), F.lit(GROUP))
        groups = F.transform(firsts, lambda first: F.slice(all_pairs, first, F.lit(GROUP)))
        return F.when(F.size(all_pairs) > 0, let(groups, by_group)).otherwise(F.array().cast(hits_type))

    return let(pairs, grouped)


def spans(text: Column, kind: Kind, near: int = NEAR) -> Column:
    """Confirmed spans of one kind: array of (kind, start, end, score), in text order.

    Places are code points. The text between matches gives the places: a match starts after the
    lengths of all that came before it. The time grows with the length of the text.
    """
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def pairs(matches: Column) -> Column:
        n = F.size(matches)
        zipped = lambda between: F.arrays_zip(
            matches.alias("match"), F.slice(between, F.lit(1), n).alias("gap"), F.slice(between, F.lit(2), n).alias("after")
        )
        return let(F.split(text, kind.pattern, -1), zipped)

    confirmed = F.filter(_placed(let(found, pairs), kind, near), lambda hit: kind.check(hit["match"]))
    scored = F.transform(
        confirmed,
        lambda hit: F.struct(
            hit["kind"].alias("kind"), hit["start"].alias("start"), hit["end"].alias("end"),
            (
                F.lit(kind.score)
                + F.when(hit["context"].rlike(kind.words), STEP).otherwise(0.0)
                - F.when(hit["context"].rlike(kind.against), STEP).otherwise(0.0)
            ).alias("score"),
        ),
    )
    none = "array<struct<kind:string,start:int,end:int,score:double>>"
    return F.when(text.rlike(kind.needs), scored).otherwise(F.array().cast(none)).cast(none)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR, limit: float = LIMIT) -> DataFrame:
    """One row per row of ``docs``: the id, ``base`` and ``added``, arrays of (kind, start, end, score).

    Places are code points of the whole text, ends exclusive. Base spans all stay, whatever their
    score; added ones need a score of ``limit``. Null and empty texts give empty arrays; repeated
    rows are each reported; other columns are not read, so their names cannot clash, and an empty table
    gives an empty result. Very long texts are read whole, in time that grows with their length. Spans
    of different kinds may overlap.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    added = F.flatten(F.array(*[spans(F.col("text"), k, near) for k in ADDED]))
    return rows.select(
        F.col("id").alias(id_col),
        F.flatten(F.array(*[spans(F.col("text"), k, near) for k in BASE])).alias("base"),
        F.filter(added, lambda s: s["score"] >= limit).alias("added"),
    )


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and joined places of what :func:`find_pii` returns."""

    def joined(hits: Column) -> Column:
        return F.array_join(F.transform(hits, lambda h: F.concat_ws(":", h["kind"], h["start"], h["end"])), ",")

    def count(name: str) -> Column:
        return F.size(F.filter("base", lambda h: h["kind"] == name)).cast("long").alias(f"n_{name}")

    counts = [count(k.name) for k in BASE]
    everything = F.concat("base", "added")
    return found.select(
        id_col,
        *counts,
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(everything).alias("spans"),
        F.array_join(F.transform(everything, lambda h: F.format_number(h["score"], 2)), ",").alias("scores"),
    )
