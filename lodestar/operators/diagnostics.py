"""Output of checkers as rows: file, line, column, severity, message, rule, source. Tools are not run here; their output
is read as a table of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Line formats of compilers, as (file, line, column or None, severity or None, rule or None, message).
LINE_FORMATS = {
    "tsc": (r"^(.+?)\((\d+),(\d+)\):\s*(error|warning)\s+(TS\d+):\s*(.+)$", (1, 2, 3, 4, 5, 6)),
    "go vet": (r"^(.+?):(\d+):(\d+):\s*(.+)$", (1, 2, 3, None, None, 4)),
    "javac": (r"^(.+?):(\d+):\s*(error|warning):\s*(.+)$", (1, 2, None, 3, None, 4)),
    "gcc": (r"^(.+?):(\d+):(\d+):\s*(error|warning):\s*(.+)$", (1, 2, 3, 4, None, 5)),
    "kotlinc": (r"^(.+?):(\d+):(\d+):\s*(error|warning):\s*(.+)$", (1, 2, 3, 4, None, 5)),
    "swiftc": (r"^(.+?):(\d+):(\d+):\s*(error|warning):\s*(.+)$", (1, 2, 3, 4, None, 5)),
    "dotnet": (r"^(.+?)\((\d+),(\d+)\):\s*(error|warning)\s+(\w+):\s*(.+)$", (1, 2, 3, 4, 5, 6)),
    "scalac": (r"^(.+?):(\d+):\s*(error|warning):\s*(.+)$", (1, 2, None, 3, None, 4)),
    "mix": (r"^\*\*\s*\((\w+)\)\s*(.+?):(\d+):\s*(.+)$", (2, 3, None, None, 1, 4)),
}
#: JSON tools: schema of the output, array of findings, and the fields of a finding (SQL; x is the finding).
JSON_FORMATS = {
    "pyright": ("generalDiagnostics array<struct<file string, severity string, message string, rule string, range struct<start struct<line int, character int>>>>", "generalDiagnostics", ("x.file", "x.range.start.line + 1", "x.range.start.character + 1", "x.severity", "x.message", "x.rule")),
    "ruff": ("items array<struct<filename string, code string, message string, location struct<`row` int, `column` int>>>", "items", ("x.filename", "x.location.row", "x.location.column", "'warning'", "x.message", "x.code")),
    "golangci-lint": ("Issues array<struct<FromLinter string, Text string, Pos struct<Filename string, `Line` int, `Column` int>>>", "Issues", ("x.Pos.Filename", "x.Pos.Line", "x.Pos.Column", "'warning'", "x.Text", "x.FromLinter")),
    "rubocop": ("files array<struct<path string, offenses array<struct<severity string, message string, cop_name string, location struct<`line` int, `column` int>>>>>", "flatten(transform(files, f -> transform(f.offenses, o -> struct(f.path as path, o as o))))", ("x.path", "x.o.location.line", "x.o.location.column", "if(x.o.severity in ('error', 'fatal'), 'error', 'warning')", "x.o.message", "x.o.cop_name")),
    "phpstan": ("files map<string, struct<messages array<struct<message string, `line` int>>>>", "flatten(transform(map_entries(files), f -> transform(f.value.messages, m -> struct(f.key as path, m as m))))", ("x.path", "x.m.line", "0", "'error'", "x.m.message", "cast(null as string)")),
    "ktlint": ("items array<struct<file string, errors array<struct<`line` int, `column` int, message string, rule string>>>>", "flatten(transform(items, f -> transform(f.errors, m -> struct(f.file as path, m as m))))", ("x.path", "x.m.line", "x.m.column", "'warning'", "x.m.message", "x.m.rule")),
    "swiftlint": ("items array<struct<file string, `line` int, `character` int, severity string, reason string, rule_id string>>", "items", ("x.file", "x.line", "x.character", "lower(x.severity)", "x.reason", "x.rule_id")),
    "credo": ("issues array<struct<filename string, line_no int, `column` int, message string, `check` string>>", "issues", ("x.filename", "x.line_no", "x.column", "'warning'", "x.message", "x.check")),
}
CARGO = "reason string, message struct<level string, message string, code struct<code string>, spans array<struct<file_name string, line_start int, column_start int, is_primary boolean>>>"
#: XML tools: schema of the output (attributes have an underscore in front).
XML_FORMATS = {
    "cppcheck": "errors struct<error: array<struct<_id: string, _severity: string, _msg: string, location: array<struct<_file: string, _line: int>>>>>",
    "checkstyle": "file array<struct<_name: string, error: array<struct<_line: int, _column: int, _severity: string, _message: string, _source: string>>>>",
}


def from_lines(lines: DataFrame, tool: str, text: str = "text") -> DataFrame:
    """lines: a column of output lines."""
    pattern, (file, line, column, severity, rule, message) = LINE_FORMATS[tool]
    part = lambda i: F.regexp_extract(text, pattern, i)
    return lines.where(F.col(text).rlike(pattern)).select(part(file).alias("file"), part(line).cast("int").alias("line"), (part(column).cast("int") if column else F.lit(0)).alias("column"), (part(severity) if severity else F.lit("error")).alias("severity"), F.trim(part(message)).alias("message"), (part(rule) if rule else F.lit(None).cast("string")).alias("rule"), F.lit(tool).alias("source"))


def from_json_output(outputs: DataFrame, tool: str, text: str = "text") -> DataFrame:
    """outputs: a column with a tool's whole output."""
    schema, items, (file, line, column, severity, message, rule) = JSON_FORMATS[tool]
    whole = F.concat(F.lit('{"items":'), F.col(text), F.lit("}")) if schema.startswith("items") else F.col(text)
    found = outputs.select(F.from_json(whole, schema).alias("o")).select("o.*").select(F.explode(F.expr(items)).alias("x"))
    return found.selectExpr(f"{file} as file", f"cast({line} as int) as line", f"cast({column} as int) as column", f"{severity} as severity", f"{message} as message", f"{rule} as rule", f"'{tool}' as source")


def from_cargo(lines: DataFrame, text: str = "text", tool: str = "cargo") -> DataFrame:
    """JSON lines of cargo check and clippy: compiler messages with their primary span."""
    m = lines.select(F.from_json(text, CARGO).alias("o")).where("o.reason = 'compiler-message' and o.message.level in ('error', 'warning')")
    return m.withColumn("s", F.expr("filter(o.message.spans, s -> s.is_primary)[0]")).where("s is not null").selectExpr("s.file_name as file", "s.line_start as line", "s.column_start as column", "o.message.level as severity", "o.message.message as message", "o.message.code.code as rule", f"'{tool}' as source")


def from_xml_output(outputs: DataFrame, tool: str, text: str = "text") -> DataFrame:
    whole = outputs.select(F.from_xml(text, XML_FORMATS[tool]).alias("o")).select("o.*")
    if tool == "checkstyle":
        x = whole.select(F.explode("file").alias("f")).select("f._name", F.explode("f.error").alias("e"))
        return x.selectExpr("_name as file", "e._line as line", "coalesce(e._column, 0) as column", "e._severity as severity", "e._message as message", "e._source as rule", "'checkstyle' as source")
    x = whole.select(F.explode("errors.error").alias("e"))
    return x.selectExpr("e.location[0]._file as file", "e.location[0]._line as line", "0 as column", "e._severity as severity", "e._msg as message", "e._id as rule", "'cppcheck' as source")


def counts(found: DataFrame) -> DataFrame:
    return found.agg(F.count_if(F.col("severity") == "error").alias("error_count"), F.count_if(F.col("severity") == "warning").alias("warning_count"), F.count_distinct("file").alias("file_count"))


def rendered(severity: Column, file: Column, line: Column, column: Column, message: Column, rule: Column) -> Column:
    head = F.concat(F.upper(F.substring(severity, 1, 1)), F.lit(" "), file, F.lit(":"), line.cast("string"), F.lit(":"), column.cast("string"), F.lit(": "), message)
    return F.concat(head, F.when(rule.isNotNull() & (rule != ""), F.concat(F.lit(" ["), rule, F.lit("]"))).otherwise(""))
