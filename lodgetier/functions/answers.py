"""Reading flags and tiers out of texts and free-form answers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodgetier.constants import BLANKS, FLAG_WORDS, FLAGS, NON_ASCII_SHARE, VOCABULARY


def non_english(text: Column, share: float = NON_ASCII_SHARE) -> Column:
    """Whether more than `share` of the characters lie outside ASCII; false for no text."""
    foreign = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return F.coalesce(foreign / F.nullif(F.length(text), F.lit(0)) > share, F.lit(False))


def plural(word: str) -> str:
    """The regular plural of an English word or of a phrase that ends in one."""
    if re.search("[^aeiou]y$", word):
        return word[:-1] + "ies"
    return word + ("es" if re.search("(s|x|z|ch|sh)$", word) else "s")


def text_flag(text: Column, words: tuple[str, ...]) -> Column:
    """1 where one of the words occurs, alone or in the plural, else 0."""
    forms = [re.escape(form) for word in words for form in (word, plural(word))]
    pattern = "(?<![a-z])(?:" + "|".join(forms) + ")(?![a-z])"
    return F.coalesce(F.lower(text).rlike(pattern).cast("int"), F.lit(0))


def text_flags(text: Column) -> dict[str, Column]:
    return {name: text_flag(text, words) for name, words in FLAG_WORDS.items()}


def first_mentioned(text: Column, column: str) -> Column:
    """The valid value of `column` that the text mentions first; null if it mentions none."""
    lowered = F.lower(text)

    def place(value: str) -> Column:
        """Where the value first stands as words of its own."""
        return F.nullif(F.regexp_instr(lowered, F.lit(f"(?<![a-z0-9]){re.escape(value.lower())}(?![a-z0-9])")), F.lit(0))

    mentions = F.array(*[F.struct(place(v).alias("at"), F.lit(v).alias("value")) for v in VOCABULARY[column]])
    return F.array_min(F.filter(mentions, lambda m: m["at"].isNotNull()))["value"]


def parsed_flags(answer: Column) -> Column:
    """The six flags, as a struct, from the JSON object inside an answer; all 0 where there is none.

    A flag is 1 for true, non-zero numbers and non-empty texts, lists and objects.
    """
    body = F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit(""))
    # The parser stops after one value, so text behind it goes unnoticed. In a list such text breaks
    # the list unless it starts with "]", in an object unless it starts with "}": both must hold.
    listed = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    held = F.try_parse_json(F.concat(F.lit('{"answer": '), body, F.lit("}")))
    alone = held.isNotNull() & listed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    fields = ", ".join(f"{name} VARIANT" for name in FLAGS)
    flags = F.from_json(F.when(alone, body), f"STRUCT<{fields}>")
    judged = F.transform(F.array(flags), lambda f: F.struct(*[_truth(f[name]).alias(name) for name in FLAGS]))
    return F.get(judged, F.lit(0))


def _truth(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(value.isNull() | (kind == "VOID"), 0)
        .when(kind == "BOOLEAN", (text == "true").cast("int"))
        .when(kind == "STRING", (text != "").cast("int"))
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), (~text.isin("{}", "[]")).cast("int"))
        .otherwise((text.try_cast("double") != 0).cast("int"))
    )


def parsed_tier(answer: Column) -> Column:
    """The first digit 0 to 3 in an answer, else 1."""
    digit = F.nullif(F.regexp_extract(F.btrim(answer, F.lit(BLANKS)), "[0-3]", 0), F.lit(""))
    return F.coalesce(digit.try_cast("int"), F.lit(1))
