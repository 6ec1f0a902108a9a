import pytest

from quillstack.functions import filters as f
from quillstack.functions.re2 import java
from pyspark.sql import functions as F

CASES = [
    ("[[:digit:]]+", "12 34", True), ("^[[:digit:]]+$", "12 34", False), ("^[[:^alpha:]x]+$", "1-x", True), ("(?P<n>a)b", "cab", True), ("(?<n>a)b", "cab", True),
    ("a$", "a\n", False), ("(?m)a$", "a\nb", True), ("(?m)^b", "a\nb", True), ("^b", "a\nb", False), ("(?m:^)b$", "a\nb", True), ("(?m:a)$", "a\nb", False),
    ("a.b", "a\nb", False), ("(?s)a.b", "a\nb", True), ("a.b", "a\rb", True), ("(?i)ÉTÉ", "été", True), ("(?i:A)B", "aB", True), ("(?i:A)B", "ab", False), ("(?U)a+", "aa", True),
    (r"^\s$", "\x0b", False), (r"^\v$", "\x0b", True), (r"^[\s]$", "\x0b", False), (r"^\S$", "\x0b", True), ("[]a]+", "]", True), ("^[^]a]$", "]", False), ("[a&&b]", "&", True), ("^[[]$", "[", True),
    (r"\x{1F600}", "\U0001f600", True), (r"\101", "A", True), (r"\pL", "é", True), (r"\p{Greek}", "λ", True), (r"\p{^Greek}", "λ", False), (r"\Qa.b\E", "a.b", True), (r"\Qa.b\E", "axb", False),
    ("a{,2}", "a{,2}", True), ("^a{2}$", "aa", True), ("x{", "x{", True), ("}", "}", True), (r"\bfoo\b", "a foo b", True), (r"\bfoo\b", "éfooé", True), (r"a\B", "ab", True), ("", "", True), ("a|b", "b", True), ("(?i)", "x", True), (r"\.", "x", False), ("^[a-c]+?$", "abc", True),
]
REFUSED = ["a++", "a*+", "a**", "(?>a)", "(?=a)", "(?<!a)b", r"(a)\1", r"\C", r"\Z", r"\G", r"\h", r"\u0041", "(?x)a", "*a", "a|*", "(a", "a)", "[a", "[[:nope:]]", "a{1001}", "a{3,2}", "\\"]


def test_patterns(spark):
    rows = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CASES)], "i int, t string")
    told = rows.select("i", *[f.regexp(p)(F.col("t")).alias(f"c{i}") for i, (p, _, _) in enumerate(CASES)]).collect()
    wrong = [CASES[r.i] for r in told if r[f"c{r.i}"] != CASES[r.i][2]]
    assert not wrong


@pytest.mark.parametrize("pattern", [*REFUSED, r"\p{Nope}", r"[a-\d]", r"[\w-z]", "[z-a]", r"\x{110000}"])
def test_refused(spark, pattern):
    with pytest.raises(ValueError):
        java(pattern)
