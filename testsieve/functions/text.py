"""Column expressions over test source text: comments, tokens, names and identifiers.

Words are ASCII here ([A-Za-z0-9_]); expressions avoid \\w and \\b, whose reach differs between engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let

# Comment and token expressions, in the order in which they apply.
COMMENTS = [r"(?dm)//.*?$", r"(?s)/\*.*?\*/", r"(?dm)#.*?$"]
FUNCTION_NAME, CLASS_NAME, TEST_CLASS = r"function\s+([A-Za-z0-9_]+)", r"class\s+([A-Za-z0-9_]+)", r"^.*Test(Case|Duplicate)?$"
METHOD_CALL, ASSERTION = r"->([A-Za-z0-9_]+)\s*\(", r"(?i)assert[A-Za-z0-9_]*"
TEST_KEYWORD = r"(?i)(?<![A-Za-z0-9_])(test|expect|mock|stub|spy|fake|fixture|teardown|setup)[A-Za-z0-9_]*"
VARIABLE, QUOTED = r"\$([a-zA-Z_][A-Za-z0-9_]{2,})", r"[\"']([^\"']{3,})[\"']"

# Words that say nothing about a test.
STOP_WORDS = (
    "the and or but in on at to for of with a an is it this that these those are was were been be have has had do does did "
    "will would should could can may might must shall as if when where why how what which who whom whose"
).split()

# Keywords of the language and words of tests that stay as they are.
LANGUAGE_WORDS = (
    "function class if else elseif foreach for while return throw try catch finally new public private protected static abstract "
    "interface extends implements true false null array string int bool void"
).split()
TEST_WORDS = (
    "success fail failure error exception valid invalid empty null true false create update delete save find get set add remove "
    "check verify validate expect assert throw catch mock stub spy authorized unauthorized authenticated guest admin user before "
    "after with without should when given then"
).split()
MEANINGFUL = r"(?i)^(password|user|admin|member|email|name|id|status|type|result|response|request)$"


def strip_comments(text: Column) -> Column:
    for pattern in COMMENTS:
        text = F.regexp_replace(text, pattern, "")
    return text


def raw_tokens(text: Column) -> Column:
    """The tokens of seven families, one family after the other, in order of place."""

    def every(pattern: str, group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    classes = F.filter(every(CLASS_NAME, 1), lambda c: ~F.rlike(c, F.lit(TEST_CLASS)))
    return F.concat(every(FUNCTION_NAME, 1), classes, every(METHOD_CALL, 1), every(ASSERTION, 0), every(TEST_KEYWORD, 1), every(VARIABLE, 1), every(QUOTED, 1))


def split_tokens(tokens: Column) -> Column:
    """Each token, then its camel-case pieces, then its snake-case pieces; single characters go."""

    def pieces(t: Column) -> Column:
        camel = F.split(F.trim(F.regexp_replace(F.regexp_replace(t, "([a-z])([A-Z])", "$1 $2"), r"\s+", " ")), " ")
        return F.concat(F.array(t), camel, F.split(t, "_"))

    return F.filter(F.flatten(F.transform(tokens, pieces)), lambda t: F.length(t) > 1)


def tokenize(text: Column, lowercase: bool = True) -> Column:
    """Tokens of a source text, repeats kept, without stop words."""
    tokens = split_tokens(raw_tokens(strip_comments(text)))
    if lowercase:
        tokens = F.transform(tokens, lambda t: F.lower(t))
    return F.filter(tokens, lambda t: ~t.isin(STOP_WORDS))


def test_name(path: Column) -> Column:
    """The name that a path or identifier gives a test; null for the empty one."""
    found = [F.regexp_extract(path, p, 1) for p in (r"([^/\\]+)(?:Test)?\.php$", r"::([A-Za-z0-9_]+)$", r"#([A-Za-z0-9_]+)$", r"@([A-Za-z0-9_]+)$")]
    last = F.element_at(F.split(path, r"[/\\:#@]"), -1)
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found], F.nullif(F.regexp_replace(last, r"\.php$", ""), F.lit("")))


def normalize_code(code: Column) -> Column:
    """Code without comments and the insides of string literals, white space collapsed."""
    for pattern, by in ((r"(?s)/\*.*?\*/", ""), (r"(?dm)//.*?$", ""), (r'"[^"]*"', '""'), (r"'[^']*'", "''"), (r"\s+", " ")):
        code = F.regexp_replace(code, pattern, by)
    return code


def code_tokens(code: Column) -> Column:
    """Of each word of normalized code what its first matching rule makes of it; words without a rule go."""
    words = F.regexp_extract_all(code, F.lit("[A-Za-z0-9_]+"), F.lit(0))
    called = F.array_distinct(F.regexp_extract_all(code, F.lit(r"([A-Za-z0-9_]+)\s*\("), F.lit(1)))

    def token(w: Column, called: Column) -> Column:
        low = F.lower(w)
        return (
            F.when(low.isin(LANGUAGE_WORDS) | low.isin(TEST_WORDS), low)
            .when(F.array_contains(called, w), F.concat(F.lit("call_"), low))
            .when(F.contains(low, F.lit("assert")) | F.contains(low, F.lit("expect")), low)
            .when(F.rlike(w, F.lit("^[A-Z][a-zA-Z0-9]*$")), F.concat(F.lit("class_"), low))
            .when(F.rlike(w, F.lit(MEANINGFUL)), low)
            .when(F.rlike(w, F.lit(r"^([0-9]+|[0-9]+[eE][0-9]+)$")), F.lit("num"))
        )

    return let(called, lambda c: F.filter(F.transform(words, lambda w: token(w, c)), lambda t: t.isNotNull()))


def split_identifier(identifier: Column) -> tuple[Column, Column]:
    """(path, method) of `path::method`, cut at the first `::`; without one the path is Unknown."""
    at = F.instr(identifier, "::")
    path = F.when(at > 0, F.substring(identifier, F.lit(1), at - 1)).otherwise(F.lit("Unknown"))
    return path, F.when(at > 0, F.substring(identifier, at + 2, F.length(identifier))).otherwise(identifier)


def class_from_path(path: Column, base: str = "") -> Column:
    """The class name of a file: base path and suffix go, slashes become backslashes, the tests folder is capitalised."""
    rest = F.regexp_replace(F.regexp_replace(path, "^" + base, "") if base else path, r"\.php$", "")
    rest = F.regexp_replace(rest, "^tests/", "Tests/")
    return F.translate(rest, "/", "\\")


def skipped_file(name: Column, exclude: list[str], focus: list[str]) -> Column:
    """Whether coverage of a file is left out."""
    path = F.translate(name, "\\", "/")
    out = F.lit(False)
    for part in [".git", "tests", "resources/views", *exclude]:
        out = out | F.contains(path, F.lit(f"/{part}/"))
    if focus:
        near = F.lit(False)
        for part in focus:
            near = near | F.contains(path, F.lit(f"/{part}/"))
        out = out | ~near
    return out | ~F.endswith(path, F.lit(".php"))


def method_body(code: Column, method: Column) -> Column:
    """The text of a method from its header to the brace that closes it; empty if there is none.

    The running depth of braces is kept by one pass over the characters from the header on."""
    header = F.concat(F.lit(r"(?:public\s+)?function\s+"), method, F.lit(r"\s*\("))
    at = F.regexp_instr(code, header)
    rest = F.substring(code, at, F.length(code))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(state: Column, c: Column) -> Column:
        depth = state["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        n = state["n"] + 1
        end = F.when((state["end"] == 0) & (c == "}") & (depth == 0), n).otherwise(state["end"])
        return F.struct(depth.alias("depth"), n.alias("n"), end.alias("end"))

    end = F.aggregate(F.split(rest, ""), start, step, lambda s: s["end"])
    return F.when(at == 0, F.lit("")).otherwise(F.substring(rest, F.lit(1), end))
