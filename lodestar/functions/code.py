"""Column functions over names, paths and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the tags, patterns of durable and entry-point names, known extensions.
TAGS = {
    "crud": "create|read|update|delete|insert|select|save|load|fetch|store|persist|get|set|add|remove",
    "validation": "valid|validate|check|verify|assert|ensure|sanitize|normalize|parse|format",
    "transform": "convert|transform|map|reduce|filter|sort|merge|split|join|serialize|deserialize",
    "error_handling": "try|catch|except|raise|throw|error|exception|fail|panic",
    "async_ops": "async|await|promise|future|callback|then|concurrent|parallel|thread",
    "iteration": "for|while|loop|iterate|each|map|reduce|filter",
    "api_endpoint": "route|endpoint|handler|controller|get|post|put|delete|patch|request|response",
    "database": "query|sql|select|insert|update|delete|table|schema|migration|model|entity",
    "auth": "auth|login|logout|session|token|jwt|oauth|permission|role|access",
    "cache": "cache|memoize|memo|store|redis|memcache|ttl|expire|invalidate",
    "test": "test|spec|mock|stub|assert|expect|should|describe|it",
    "logging": "log|logger|debug|info|warn|error|trace|print|console",
    "config": "config|setting|option|env|environment|parameter|argument",
}
BRANCHES = "if|elif|else|case|switch|match"
LOOPS = "for|while|loop"
DURABLE = ["node_modules/", ".venv/", "venv/", "vendor/", "__pycache__/", "site-packages/", ".tox/", "dist-packages/"]
ENTRY_POINTS = ["main", "__main__", "cli", "app", "run", "start", "test_", "pytest_", "setup", "teardown"]
EXTENSIONS = "py|pyi|ts|tsx|js|jsx|mjs|cjs|go|rs|java|c|h|cpp|hpp|cc|hh|cxx|rb|php|cs|kt|kts|scala|swift|lua|ex|exs"


def has_word(text: Column, words: str) -> Column:
    """One of the words occurs whole; words are of ASCII letters, digits and underscores."""
    return text.rlike(f"(^|[^A-Za-z0-9_])({words})([^A-Za-z0-9_]|$)")


def count_words(text: Column, words: str) -> Column:
    tokens = F.split(F.regexp_replace(text, "[^A-Za-z0-9_]+", " "), " ")
    return F.size(F.filter(tokens, lambda t: t.isin(words.split("|")))).cast("long")


def semantic_tags(text: Column) -> Column:
    """Sorted names of the categories with a word in the text. The text is split once, into its distinct words."""
    words = F.array_distinct(F.split(F.lower(text), "[^A-Za-z0-9_]+"))
    member = lambda w, ws: F.arrays_overlap(w, F.array(*map(F.lit, ws.split("|"))))
    found = F.transform(F.array(words), lambda w: F.array_compact(F.array(*[F.when(member(w, ws), t) for t, ws in sorted(TAGS.items())])))
    return F.get(found, F.lit(0))


def indent_depth(line: Column) -> Column:
    """Levels of four columns; a tab is four; blank lines have none."""
    lead = F.regexp_extract(line, r"^([ \t]*)[^ \t]", 1)
    return F.floor(F.length(F.replace(lead, F.lit("\t"), F.lit("    "))) / 4).cast("long")


def max_depth(text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.split(text, "\n"), indent_depth)), F.lit(0)).cast("long")


CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B81F}\x{F900}-\x{FAFF}\x{3000}-\x{30FF}\x{AC00}-\x{D7AF}]"
EMOJI = r"[\x{1F300}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{1F000}-\x{1F02F}]"


def token_estimate(text: Column) -> Column:
    """Tokens by kind of character: ASCII a quarter, CJK one and a half, symbols and emoji three, others a half."""
    n = F.length(text)
    # only what is not ASCII is looked at by kind
    rest = F.when(F.octet_length(text) > n, F.regexp_replace(text, r"[\x00-\x7F]+", "")).otherwise("")
    counted = F.struct(F.length(rest).alias("n"), (F.length(rest) - F.length(F.regexp_replace(rest, f"{CJK}+", ""))).alias("cjk"), (F.length(rest) - F.length(F.regexp_replace(rest, f"{EMOJI}+", ""))).alias("emoji"))
    weight = lambda x: (n - x["n"]) / 4 + x["cjk"] * 1.5 + x["emoji"] * 3 + (x["n"] - x["cjk"] - x["emoji"]) / 2
    value = F.greatest(F.lit(1), F.floor(F.get(F.transform(F.array(counted), weight), F.lit(0))))
    return F.when(n > 0, value).otherwise(0).cast("long")


def truncated_to_tokens(text: Column, most: int) -> Column:
    """text, or its longest prefix of an estimate of at most that many tokens."""
    quarters = lambda c: F.when(c.rlike(r"[\x00-\x7F]"), 1).when(c.rlike(CJK), 6).when(c.rlike(EMOJI), 12).otherwise(2)

    def take(acc: Column, c: Column) -> Column:
        w = acc["w"] + quarters(c)
        return F.struct(w.alias("w"), (acc["n"] + F.when(w < 4 * (most + 1), 1).otherwise(0)).alias("n"))

    fitting = F.aggregate(F.split(text, ""), F.struct(F.lit(0).alias("w"), F.lit(0).alias("n")), take, lambda acc: acc["n"])
    return F.when(token_estimate(text) <= most, text).otherwise(F.substring(text, F.lit(1), fitting))


def identifier_words(name: Column) -> Column:
    """snake, camel and acronym names as lower-case words."""
    spaced = F.regexp_replace(F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(spaced, r"\s+", " ")))


def is_test(path: Column) -> Column:
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    return (
        name.rlike(r"^(test_.*|.*_test|test|tests|conftest)\.py$")
        | name.rlike(r"^(.*\.(test|spec)\..*|test_.*|.*_test\.)(js|jsx|ts|tsx)$")
        | name.rlike(r"_test\.go$|^test_.*\.rs$|^tests\.rs$")
        | F.arrays_overlap(F.split(low, "/"), F.array(F.lit("test"), F.lit("tests"), F.lit("__tests__")))
    )


def any_contained(value: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(value, F.lit(p))
    return out


def is_durable(path: Column) -> Column:
    return any_contained(F.replace(path, F.lit("\\"), F.lit("/")), DURABLE)


def package_key(path: Column) -> Column:
    """The package a vendored file belongs to, else the first directory."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    after = lambda mark: F.element_at(F.split(p, mark), -1)
    node, site, vendor = (after(m) for m in ("node_modules/", "site-packages/", "vendor/"))
    first = lambda c: F.element_at(F.split(c, "/"), 1)
    return (
        F.when(F.contains(p, F.lit("node_modules/")), F.when(node.rlike("^@[^/]*/"), F.regexp_extract(node, "^(@[^/]*/[^/]*)", 1)).otherwise(first(node)))
        .when(F.contains(p, F.lit("site-packages/")), first(site))
        .when(F.contains(p, F.lit("vendor/")), F.when(vendor.rlike(r"^[^/]*\.[^/]*/[^/]*/"), F.regexp_extract(vendor, "^([^/]*/[^/]*/[^/]*)", 1)).otherwise(first(vendor)))
        .otherwise(first(p))
    )


def module_name(path: Column) -> Column:
    """Dotted name of a Python file; a package's __init__ is the package."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def normal_module(module: Column) -> Column:
    """Without leading path prefixes, known extension and index file."""
    short = F.regexp_replace(module, r"^(@/|~/|\./|\.\./|src/|lib/|app/|packages/)+", "")
    return F.regexp_replace(F.regexp_replace(short, rf"(?i)\.({EXTENSIONS})$", ""), "/index$", "")


def module_matches(pattern: Column, module: Column, names: Column | None = None) -> Column:
    """Substring, imported name, or equal, suffix, prefix after normalisation."""
    p, m = normal_module(pattern), normal_module(module)
    own = F.contains(module, pattern) | (F.array_contains(names, pattern) if names is not None else F.lit(False))
    near = (p == m) | F.endswith(m, F.concat(F.lit("/"), p)) | F.startswith(m, F.concat(p, F.lit("/")))
    return (F.length(pattern) > 0) & (own | ((F.length(p) > 0) & near))


def in_workspace(path: Column, active: list[str], excluded: list[str]) -> Column:
    """Under an active package (if any are named), and matching no exclude pattern; ``**`` patterns mean that one of
    their literal parts is a part of the path."""
    under = F.lit(not active)
    for a in active:
        under = under | (path == a) | F.startswith(path, F.lit(f"{a}/"))
    out = F.lit(False)
    for pattern in excluded:
        if "**" in pattern:
            for part in (x.rstrip("*") for x in pattern.split("/")):
                if part:
                    out = out | F.startswith(path, F.lit(f"{part}/")) | F.contains(path, F.lit(f"/{part}/")) | (path == part)
        else:
            quoted = "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in r"\.^$+{}[]|()" else c) for c in pattern)
            out = out | path.rlike(f"^{quoted}$")
    return under & ~out


def signature(language: Column, name: Column, params: Column, returns: Column, is_async: Column) -> Column:
    """A function's head in its language's syntax."""
    inside, a = F.concat(name, F.lit("("), F.array_join(params, ", "), F.lit(")")), F.when(is_async, "async ").otherwise("")
    typed = lambda sep: F.when(returns.isNotNull(), F.concat(F.lit(sep), returns)).otherwise("")
    before = F.when(returns.isNotNull(), F.concat(returns, F.lit(" "))).otherwise("")
    return (
        F.when(language == "python", F.concat(a, F.lit("def "), inside, typed(" -> ")))
        .when(language.isin("typescript", "javascript"), F.concat(a, F.lit("function "), inside, typed(": ")))
        .when(language == "go", F.concat(F.lit("func "), inside, typed(" ")))
        .when(language == "rust", F.concat(a, F.lit("fn "), inside, typed(" -> ")))
        .when(language == "kotlin", F.concat(F.lit("fun "), inside, typed(": ")))
        .when(language == "scala", F.concat(F.lit("def "), inside, typed(": ")))
        .when(language == "swift", F.concat(F.lit("func "), inside, typed(" -> ")))
        .when(language.isin("ruby", "elixir"), F.concat(F.lit("def "), inside))
        .when(language.isin("php", "lua"), F.concat(F.lit("function "), inside))
        .when(language.isin("java", "c", "cpp", "csharp"), F.concat(before, inside))
        .otherwise(F.concat(F.lit("def "), inside, typed(" -> ")))
    )


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Array of (index, start, text): windows of size characters, each overlapping the last; the one that reaches the
    end is the last."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - size) / step) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("chunk_index"), (i * step).alias("start"), F.substring(text, i * step + 1, F.lit(size)).alias("chunk")))
