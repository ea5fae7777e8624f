"""Text functions: code and answers in model output, LaTeX, names, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, pattern: str) -> Column:
    """The first group of the first match; null where there is no match (an empty match stays empty)."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


EXECUTE = r"(?s)<execute>(.*?)</execute>"
FENCE = r"(?s)```(?:python|py)?[ \t]*\n(.*?)```"
BARE = r"(?s)((?:^|(?<=\n))def [^\n]*\n.*?return[^\n]*)"
FINAL = r"(?s)<final_answer>(.*?)</final_answer>"


def extract_code(text: Column) -> Column:
    """An <execute> block, else a fenced block, else a bare function up to its first return line; else null."""
    found = F.coalesce(first_match(text, EXECUTE), first_match(text, FENCE), first_match(text, BARE))
    return F.nullif(F.trim(found, F.lit(" \t\n\r")), F.lit(""))


def execute_blocks(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(EXECUTE), F.lit(1)), lambda b: F.trim(b, F.lit(" \t\n\r")))


def final_answer(text: Column) -> Column:
    return F.trim(first_match(text, FINAL), F.lit(" \t\n\r"))


def latex_variables(latex: Column) -> Column:
    """The single letters that stand alone, but d, e and i; sorted; ['x'] where there are none."""
    letters = F.regexp_extract_all(F.regexp_replace(latex, r"\\[A-Za-z]+", " "), F.lit(r"(?<![A-Za-z])([A-Za-z])(?![A-Za-z])"), F.lit(1))
    found = F.array_sort(F.array_distinct(F.array_except(letters, F.array(*map(F.lit, "dei")))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("x")))


def latex_functions(latex: Column, names: list[str]) -> Column:
    r"""Which of the names occur, as \name, name( or \operatorname{name}."""
    has = lambda n: F.contains(latex, F.concat(F.lit("\\"), n)) | F.contains(latex, F.concat(n, F.lit("("))) | F.contains(latex, F.concat(F.lit("\\operatorname{"), n, F.lit("}")))
    return F.filter(F.array(*map(F.lit, names)), has)


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_")


def build_prompt(latex: Column, variables: Column | None = None) -> Column:
    """A request for a function that evaluates the expression."""
    names = F.array_join(variables, ", ") if variables is not None else F.lit(None).cast("string")
    return F.concat(F.lit("Write a Python function calculate for the expression "), latex, F.lit(" of "), F.coalesce(F.nullif(names, F.lit("")), F.lit("its variables")), F.lit("."))


def instruction(latex: Column, solution: Column, legacy: Column | None = None, chat: bool = False) -> Column:
    """A training text from a problem and its solution; the legacy column serves where the solution is missing."""
    code = F.coalesce(solution, legacy, F.lit("")) if legacy is not None else F.coalesce(solution, F.lit(""))
    if chat:
        return F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.trim(latex).alias("content")), F.struct(F.lit("assistant").alias("role"), F.trim(code).alias("content"))))
    return F.concat(F.lit("### Problem\n"), latex, F.lit("\n### Solution\n"), code)


def sorted_json(m: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def render(template: str, **values: Column) -> Column:
    """A template with {{name}} replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value.cast("string"))
    return out


def tally_key(reason: Column) -> Column:
    """What stands before the first ':' and then the first ';'."""
    return F.trim(F.substring_index(F.substring_index(reason, ":", 1), ";", 1))


def big_endian_seed(key: Column) -> Column:
    """The first eight bytes of SHA-256 as a number, decimal(20,0)."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_order(seed: str, key: Column) -> Column:
    """A text to order by: a permutation that depends on seed and key alone, the same in other engines."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_uniform(seed: str, key: Column) -> Column:
    """A double in [0, 1) from seed and key alone: 48 bits of MD5."""
    return F.conv(F.substring(hash_order(seed, key), 1, 12), 16, 10).cast("long") / F.lit(float(2**48))
