"""Rule coding: a codebook as parameters, multi-label codes as an ordered array column.

A codebook is data, not code: pass your own, or read it from JSON. All matching is done by higher-order functions on literals,
so a comment is coded in one pass without joins; small lexicons suit this, a large one belongs in `phrase_hits_joined`.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Codebook:
    """dimensions: name -> its codes, in order. symbols: (name, category) in order. phrases: code -> substrings.

    symbol_code is given where a symbol occurs; composed: code -> (aspects, positives, vetoes); suppressed: code -> (tokens,
    phrases that do not count against them); patterns: code -> regular expressions.
    """

    dimensions: dict[str, list[str]]
    symbols: list[tuple[str, str]] = field(default_factory=list)
    phrases: dict[str, list[str]] = field(default_factory=dict)
    symbol_code: str | None = None
    composed: dict[str, tuple[list[str], list[str], list[str]]] = field(default_factory=dict)
    suppressed: dict[str, tuple[list[str], list[str]]] = field(default_factory=dict)
    patterns: dict[str, list[str]] = field(default_factory=dict)

    @property
    def codes(self) -> list[str]:
        return [c for codes in self.dimensions.values() for c in codes]

    @property
    def dimension_of(self) -> dict[str, str]:
        return {c: d for d, codes in self.dimensions.items() for c in codes}


def read_codebook(path: str) -> Codebook:
    """A codebook from JSON with the fields of Codebook."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return Codebook(
        **spec
        | {
            "symbols": [tuple(s) for s in spec.get("symbols", [])],
            "composed": {k: tuple(v) for k, v in spec.get("composed", {}).items()},
            "suppressed": {k: tuple(v) for k, v in spec.get("suppressed", {}).items()},
        }
    )


def any_of(text: Column, tokens: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(text, t)) if tokens else F.lit(False)


#: Stands for characters that a match has taken.
TAKEN = "\0"


def symbol_matches(text: Column, symbols: list[tuple[str, str]]) -> Column:
    """array<struct<name, category>>: non-overlapping matches, longest names first over the whole text; ties keep the list's order.

    Repeated occurrences all count. Unlike leftmost-longest alternation, a long name wins over a shorter one that begins before
    it. Each name that occurs costs one pass over the text: its matches are replaced by characters that no name has.
    """
    ordered = sorted(enumerate(symbols), key=lambda s: (-len(s[1][0]), s[0]))
    book = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"), F.lit(len(n)).alias("size")) for _, (n, c) in ordered])
    present = F.filter(book, lambda s: F.contains(text, s["name"]))
    kind = "array<struct<name:string,category:string,n:int>>"

    def take(state: Column, s: Column) -> Column:
        rest = F.replace(state["rest"], s["name"], F.repeat(F.lit(TAKEN), s["size"]))
        n = ((F.length(state["rest"]) - F.length(F.replace(state["rest"], s["name"], F.lit("")))) / s["size"]).cast("int")
        return F.struct(rest.alias("rest"), F.concat(state["found"], F.array(F.struct(s["name"].alias("name"), s["category"].alias("category"), n.alias("n")))).alias("found"))

    folded = F.aggregate(present, F.struct(text.alias("rest"), F.array().cast(kind).alias("found")), take)["found"]
    each = F.transform(folded, lambda m: F.array_repeat(F.struct(m["name"].alias("name"), m["category"].alias("category")), m["n"]))
    return F.coalesce(F.flatten(each), F.array().cast("array<struct<name:string,category:string>>"))


def bounded_gap(left: list[str], right: list[str], least: int = 0, most: int = 8) -> str:
    """A pattern: a token of the left, a gap within bounds, one of the right."""
    return f"(?:{'|'.join(left)}).{{{least},{most}}}(?:{'|'.join(right)})"


def codes_of(text: Column, book: Codebook, symbols: Column | None = None) -> Column:
    """The codes of a comment in the codebook's order; blank or null text has none. Pass the column of matches if there is one."""
    symbols = symbol_matches(text, book.symbols) if symbols is None else symbols
    flags = []
    for code in book.codes:
        hit = any_of(text, book.phrases.get(code, []))
        if code in book.suppressed:
            tokens, weak = book.suppressed[code]
            strong = [p for p in book.phrases.get(code, []) if p not in weak]
            hit = hit & ~(any_of(text, tokens) & ~any_of(text, strong))
        if code in book.composed:
            aspects, positives, vetoes = book.composed[code]
            hit = hit | (~any_of(text, vetoes) & any_of(text, aspects) & any_of(text, positives))
        for pattern in book.patterns.get(code, []):
            hit = hit | text.rlike(pattern)
        if code == book.symbol_code:
            hit = hit | (F.size(symbols) > 0)
        flags.append(F.when(hit, F.lit(code)))
    kept = F.filter(F.array(*flags), lambda c: c.isNotNull())
    return F.when(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")) == "", F.array().cast("array<string>")).otherwise(kept)


def dimensions_of(codes: Column, book: Codebook) -> Column:
    """Each dimension of the codes once."""
    table = F.create_map(*[F.lit(x) for pair in book.dimension_of.items() for x in pair])
    return F.array_distinct(F.transform(codes, lambda c: table[c]))


def coded(comments: DataFrame, book: Codebook, text: str = "content") -> DataFrame:
    """comments with `symbols`, `codes` and `dims`: done once, for all that counts them later."""
    with_symbols = comments.withColumn("symbols", symbol_matches(F.col(text), book.symbols) if book.symbols else F.array().cast("array<struct<name:string,category:string>>"))
    with_codes = with_symbols.withColumn("codes", codes_of(F.col(text), book, F.col("symbols")))
    return with_codes.withColumn("dims", dimensions_of(F.col("codes"), book))


def phrase_hits_joined(comments: DataFrame, phrases: DataFrame, id_col: str, text: str = "content") -> DataFrame:
    """(id, code) for a lexicon given as a table (code, phrase) of any size: each phrase's first word is looked up among words.

    Phrases that span part of a word only are not found this way; use codes_of() for substring lexicons.
    """
    words = comments.select(id_col, text, F.explode(F.array_distinct(F.split(F.col(text), r"[^\p{L}\p{N}]+"))).alias("first"))
    keyed = phrases.withColumn("first", F.split("phrase", r"[^\p{L}\p{N}]+")[0])
    return words.join(keyed, "first").filter(F.contains(F.col(text), F.col("phrase"))).select(id_col, "code").distinct()
