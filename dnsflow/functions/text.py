"""Scalar features of a query-name label, as native column expressions.

Letter and digit classes are Unicode-aware, as labels may carry non-ASCII text.
"""

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_CONSONANT_BREAK = r"[^\p{L}]|[aeiou]"


def _kept(text: Column, drop: str) -> Column:
    return F.char_length(F.regexp_replace(text, drop, ""))


def _per_char(count: Column, text: Column) -> Column:
    return count / F.greatest(F.char_length(text), F.lit(1))


def label_length(text: Column) -> Column:
    return F.char_length(text)


def shannon_entropy(text: Column) -> Column:
    """Base-2 entropy of the characters; 0 for the empty string."""
    n = F.char_length(text)
    def term(acc: Column, char: Column) -> Column:
        p = (n - F.char_length(F.replace(text, char, F.lit("")))) / n
        return acc - p * F.log2(p)
    chars = F.array_distinct(F.split(text, ""))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(chars, F.lit(0.0), term))


def digit_ratio(text: Column) -> Column:
    return _per_char(_kept(text, r"[^\p{Nd}]"), text)


def vowel_consonant_ratio(text: Column) -> Column:
    vowels = _kept(text, "[^aeiou]")
    letters = _kept(text, r"[^\p{L}]")
    return vowels / F.greatest(letters - vowels, F.lit(1))


def max_consonant_run(text: Column) -> Column:
    """Longest run of letters that are not vowels; ``y`` is a consonant."""
    return F.array_max(F.transform(F.split(text, _CONSONANT_BREAK), lambda run: F.char_length(run)))


def hex_char_ratio(text: Column) -> Column:
    return _per_char(_kept(F.lower(text), "[^0-9a-f]"), text)


def value_entropy(values: Column) -> Column:
    """Base-2 entropy of the values of a (bounded) array; 0 when it is empty."""
    n = F.size(values)
    def term(acc: Column, value: Column) -> Column:
        p = F.size(F.filter(values, lambda v: v == value)) / n
        return acc - p * F.log2(p)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(F.array_distinct(values), F.lit(0.0), term))


def basic_features(label: Column) -> list[Column]:
    """The features that need no word list."""
    return [
        label_length(label).cast("double").alias("length"),
        shannon_entropy(label).alias("entropy"),
        digit_ratio(label).alias("digit_ratio"),
        vowel_consonant_ratio(label).alias("vowel_consonant_ratio"),
        max_consonant_run(label).cast("double").alias("max_consonant_run"),
        hex_char_ratio(label).alias("hex_char_ratio"),
    ]


def register_sql_functions(spark: SparkSession) -> None:
    """Offer the scalar features to SQL as session functions."""
    bodies = {
        "dns_label_entropy": """DOUBLE RETURN if(char_length(s) = 0, 0D, aggregate(array_distinct(split(s, '')), 0D,
            (acc, c) -> acc - ((char_length(s) - char_length(replace(s, c, ''))) / char_length(s))
                      * log2((char_length(s) - char_length(replace(s, c, ''))) / char_length(s))))""",
        "dns_digit_ratio":
            r"DOUBLE RETURN char_length(regexp_replace(s, r'[^\p{Nd}]', '')) / greatest(char_length(s), 1)",
        "dns_vowel_consonant_ratio":
            r"""DOUBLE RETURN char_length(regexp_replace(s, '[^aeiou]', ''))
                / greatest(char_length(regexp_replace(s, r'[^\p{L}]', ''))
                           - char_length(regexp_replace(s, '[^aeiou]', '')), 1)""",
        "dns_max_consonant_run":
            r"INT RETURN array_max(transform(split(s, r'[^\p{L}]|[aeiou]'), r -> char_length(r)))",
        "dns_hex_char_ratio":
            "DOUBLE RETURN char_length(regexp_replace(lower(s), '[^0-9a-f]', '')) / greatest(char_length(s), 1)",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS {body}")
