"""Top-level declarations and imports of Python, JavaScript and TypeScript files.

A line grammar, not a parser: a declaration starts on an unindented line and runs
to the next unindented line that does not merely close or comment it.  All work is
array and regular-expression functions inside one narrow stage; source text is
never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control characters that carry the line structure through the string functions.
_MARK, _SEP, _QUIET = "\u0001", "\u0002", "\u0003"

# First characters of a line that continues what came before.
_CONTINUING = ("", " ", "\t", "\r", "\f", "\x0b", ")", "]", "}", "#", "*")
# Blank and comment lines; at the end of a block they do not belong to it.
_IDLE = r"^\s*(?:$|#|//|/\*|\*)"
# Everything up to the last line that is not idle.
_TO_LAST_LINE = rf"(?s)\A(?:.*\n)?[^{_QUIET}\n][^\n]*"

# Decision tokens by language, counted for complexity.
PYTHON_DECISIONS = (
    r"(?m)^[ \t]*(?:async[ \t]+)?(?:if|elif|else|for|while|try|except|case)\b",
    r"\b(?:and|or)\b",
)
SCRIPT_DECISIONS = (
    r"(?<![.\w$])(?:if|else|for|while|do|catch|case|try)\b(?!\s*:)",
    r"\?\.(?!\d)",
    r"(?<![?])\?(?![?.:])",
)
# Escaped characters go first, so that a string is plainly quote to quote.
_ESCAPE = r"\\."
_PY_NOISE = r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"[^\"\n]*\"|'[^'\n]*'|#[^\n]*"
_JS_NOISE = r"/\*[\s\S]*?\*/|\"[^\"\n]*\"|'[^'\n]*'|`[^`]*`|//[^\n]*"

_PY_HEAD = r"^(?:async[ \t]+def|def|class)[ \t]+(\w+)"
_PY_DECORATED = r"(?m)^(?:async[ \t]+def|def|class)[ \t]+(\w+)"
_PY_IMPORT = r"^import[ \t]+([\w.]+(?:[ \t]+as[ \t]+\w+)?)"
_PY_FROM = r"^from[ \t]+(\w[\w.]*)[ \t]+import\b"
_PY_RELATIVE = r"^from[ \t]+\.+[\w.]*[ \t]+import[\s(]+([\w.]+(?:[ \t]+as[ \t]+\w+)?)"

_JS_DECLARED = r"^(?:export[ \t]+(?:default[ \t]+)?)?(?:(?:async[ \t]+)?function|class)[ \t]+([\w$]+)"
_JS_EXPORTED_CLASS = r"^export[ \t]+(?:default[ \t]+)?class[ \t]+[\w$]+"
_JS_ARROW = r"^export[ \t]+(?:const|let)[ \t]+([\w$]+)[^=\n]*=[ \t]*(?:async[ \t]*)?(?:\([^\n]*\)[^=\n]*|[\w$]+[ \t]*)=>"
_JS_IMPORT = r"^import\b[\s\S]*?[\"'`]([^\"'`]*)[\"'`]"
_TS_CLASS_LIKE = r"^(?:interface|type)[ \t]+([\w$]+)"
_TS_EXPORT_NAME = r"^export[ \t]+default[ \t]+([\w$]+)[ \t]*;?[ \t]*$"
_ARROW_PREFIX = r"^export[ \t]+(?:const|let)[ \t]+[\w$]+[^=\n]*=[ \t]*"
_EXPORT_PREFIX = r"^export[ \t]+(?:default[ \t]+)?(?=(?:async[ \t]+)?function\b|class\b)"

# The scanner.  Escaped characters are blanked first, so that every quote left opens or closes.
_ESCAPED = r"\\[^\n]"
# What no statement can begin in, read from left to right: whichever opens first wins.
_PY_SILENT = r"\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|\"[^\"\n]*\"|'[^'\n]*'|#[^\n]*"
_JS_SILENT = r"/\*[\s\S]*?\*/|//[^\n]*|\"[^\"\n]*\"|'[^'\n]*'"
# Marks at which a script with template strings can change its state.
_JS_MARKS = r"/\*|\*/|//|\n|[\"'`{}]|\$\{"


def _blanked(content: Column, silent: str) -> Column:
    """Text without strings and comments; a string leaves its first quote, and all line breaks stay."""
    code, found = F.split(content, silent, -1), F.regexp_extract_all(content, F.lit(silent), F.lit(0))

    def rest(token: Column) -> Column:
        quote = F.when(F.left(token, F.lit(1)).isin("'", '"'), F.lit('"')).otherwise("")
        return F.concat(quote, F.regexp_replace(token, r"[^\n]+", ""))

    return F.array_join(F.zip_with(code, found, lambda c, t: F.concat(c, F.coalesce(rest(t), F.lit("")))), "")


def _silent_lines(content: Column) -> Column:
    """One character per line of a script: ``1`` if it begins inside a template string, a block comment or a string, else ``0``.

    A state machine over the marks of the text.  ``mode`` says what the scanner is in: code, a line comment ``/``, a block comment ``*``, a quote, or the text of a template; ``open`` is the
    stack of what code is nested in: ``{`` for a block and ```` ` ```` for the ``${`` of a template.
    """
    start = F.struct(F.lit("").alias("mode"), F.lit("").alias("open"), F.lit("0").alias("lines"))

    def step(state: Column, mark: Column) -> Column:
        mode, stack, lines = state["mode"], state["open"], state["lines"]
        code, top = mode == "", F.right(stack, F.lit(1))
        push = lambda c: F.concat(stack, F.lit(c))
        popped = F.left(stack, F.greatest(F.length(stack) - 1, F.lit(0)))

        def to(new_mode, new_stack=stack, new_lines=lines):
            as_column = lambda x: F.lit(x) if isinstance(x, str) else x
            return F.struct(as_column(new_mode).alias("mode"), as_column(new_stack).alias("open"), new_lines.alias("lines"))

        # A line comment and an open quote end with their line.
        at_break = F.when(mode.isin("/", "'", '"'), F.lit("")).otherwise(mode)
        return (
            F.when(mark == "\n", to(at_break, new_lines=F.concat(lines, F.when(at_break == "", F.lit("0")).otherwise("1"))))
            .when(code & mark.isin("'", '"', "`"), to(mark))
            .when(code & (mark == "//"), to("/"))
            .when(code & (mark == "/*"), to("*"))
            .when(code & mark.isin("{", "${"), to("", push("{")))
            .when(code & (mark == "}"), to(F.when(top == "`", F.lit("`")).otherwise(""), popped))
            .when((mode == "`") & (mark == "${"), to("", push("`")))
            .when((mode == mark) & mark.isin("'", '"', "`") | (mode == "*") & (mark == "*/"), to(""))
            .otherwise(state)
        )

    return F.aggregate(F.regexp_extract_all(content, F.lit(_JS_MARKS), F.lit(0)), start, step, lambda state: state["lines"])


def _outside(content: Column, lines: Column, python: Column) -> Column:
    """The lines of a file as far as statements can begin in them; null where they are the lines themselves.

    Only what spans lines matters, so files without any of it are not scanned.
    """
    bare = F.regexp_replace(content, _ESCAPED, "  ")
    # As an argument of its own, the scan runs once for the file and not once for every line.
    flags = F.slice(F.split(_silent_lines(bare), ""), F.lit(1), F.size(lines))
    template = F.zip_with(lines, flags, lambda line, flag: F.when(flag == "1", F.lit("")).otherwise(line))
    return (
        F.when(python & content.rlike("\"{3}|'{3}"), F.split(_blanked(bare, _PY_SILENT), "\n"))
        .when(~python & content.contains("`"), template)
        .when(~python & content.contains("/*"), F.split(_blanked(bare, _JS_SILENT), "\n"))
    )


def _mark_lines(lines: Column, outside: Column) -> Column:
    """Text in which every statement head carries its line number and idle lines are flagged.

    ``outside`` has the same lines without what lies inside strings: only they can begin a statement.
    """

    def mark(line: Column, i: Column) -> Column:
        head = F.get(outside, i)
        continues = F.left(head, F.lit(1)).isin(*_CONTINUING) | head.startswith("//") | head.startswith("/*")
        after_decorator = (i > 0) & F.coalesce(F.get(lines, i - 1).startswith("@"), F.lit(False))
        return (
            F.when(continues, F.when(line.rlike(_IDLE), F.concat(F.lit(_QUIET), line)).otherwise(line))
            .when(after_decorator, line)
            .otherwise(F.concat(F.lit(_MARK), (i + 1).cast("string"), F.lit(_SEP), line))
        )

    return F.array_join(F.transform(lines, mark), "\n")


def _statement(block: Column) -> Column:
    text = F.regexp_extract(F.substring_index(block, _SEP, -1), _TO_LAST_LINE, 0)
    return F.struct(
        F.when(block.contains(_SEP), F.substring_index(block, _SEP, 1).cast("int")).alias("start_line"),
        F.translate(text, _QUIET, "").alias("text"),
    )


def _starts(text: Column, *words: str) -> Column:
    hit = text.startswith(words[0])
    for word in words[1:]:
        hit = hit | text.startswith(word)
    return hit


def _first(text: Column, *patterns: str) -> Column:
    """First capture of the first pattern that matches, else an empty string."""
    found = F.regexp_extract(text, patterns[-1], 1)
    for pattern in reversed(patterns[:-1]):
        found = F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), found)
    return found


def _python_name(text: Column) -> Column:
    return (
        F.when(_starts(text, "@"), _first(text, _PY_DECORATED))
        .when(_starts(text, "def", "class", "async"), _first(text, _PY_HEAD))
        .when(_starts(text, "import"), _first(text, _PY_IMPORT))
        .when(_starts(text, "from"), _first(text, _PY_FROM, _PY_RELATIVE))
    )


def _python_kind(text: Column, name: Column) -> Column:
    named = name != ""
    is_import = text.rlike(r"^(?:import|from)\b") & ~text.rlike(r"^from[ \t]+__future__\b")
    return (
        F.when(_starts(text, "import", "from"), F.when(is_import, "import"))
        .when(_starts(text, "class"), F.when(named, "class"))
        .when(named, "function")
    )


def _script_name(text: Column, typescript: Column) -> Column:
    # An export that declares neither function, class nor arrow function keeps a name
    # only when it exports one identifier.
    exported = F.when(typescript, _first(text, _JS_DECLARED, _JS_ARROW, _TS_EXPORT_NAME)).otherwise(
        _first(text, _JS_DECLARED, _JS_ARROW)
    )
    source = F.regexp_replace(F.regexp_extract(text, _JS_IMPORT, 1), r"^[./]+", "")
    return (
        F.when(_starts(text, "import"), source)
        .when(_starts(text, "export"), exported)
        .when(_starts(text, "function", "async", "class"), _first(text, _JS_DECLARED))
        .when(_starts(text, "interface", "type") & typescript, _first(text, _TS_CLASS_LIKE))
    )


def _script_kind(text: Column, name: Column, typescript: Column) -> Column:
    named = name != ""
    exported_class = text.rlike(_JS_EXPORTED_CLASS)
    return (
        F.when(_starts(text, "import"), F.when(text.rlike(r"^import\b"), "import"))
        .when(
            _starts(text, "export") & text.rlike(r"^export\b"),
            F.when(exported_class, "class").when(named | typescript, "function"),
        )
        .when(_starts(text, "class", "interface", "type"), F.when(named, "class"))
        .when(named, "function")
    )


def _count_tokens(text: Column, patterns) -> Column:
    total = F.lit(1)
    for pattern in patterns:
        total = total + F.regexp_count(text, F.lit(pattern))
    return total


def complexity(symbols: DataFrame) -> DataFrame:
    """Symbols with ``cyclomatic_complexity``: 1 + decision tokens for functions and methods, else 0.

    Strings and comments do not count.
    """
    counted = F.col("kind").isin("function", "method")
    python = F.col("language") == "python"
    plain = F.regexp_replace("source_code", _ESCAPE, "")
    bare = F.when(python, F.regexp_replace(plain, _PY_NOISE, "\"\"")).otherwise(F.regexp_replace(plain, _JS_NOISE, "\"\""))
    body = F.col("_bare")
    tokens = F.when(python, _count_tokens(body, PYTHON_DECISIONS)).otherwise(_count_tokens(body, SCRIPT_DECISIONS))
    return (
        symbols.withColumn("_bare", F.when(counted, bare))
        .withColumn("cyclomatic_complexity", F.coalesce(tokens, F.lit(0)).cast("int"))
        .drop("_bare")
    )


def extract_symbols(files: DataFrame) -> DataFrame:
    """Symbols of (repo_id, file_id, path, language, content) rows.

    ``ordinal`` counts from the last statement of the file backwards, the order in
    which symbols are stored.
    """
    spoken = files.where(F.col("language").isin("python", "javascript", "typescript"))
    python, typescript = F.col("language") == "python", F.col("language") == "typescript"
    text = F.replace("content", F.lit("\r\n"), F.lit("\n"))
    lined = spoken.select("repo_id", "file_id", "language", text.alias("content"), F.split(text, "\n").alias("lines"))
    outside = _outside(F.col("content"), F.col("lines"), python)
    marked = lined.select("repo_id", "file_id", "language", "lines", outside.alias("outside")).select(
        "repo_id", "file_id", "language", _mark_lines(F.col("lines"), F.coalesce("outside", "lines")).alias("marked")
    )

    # Everything a statement needs is worked out once, inside the generator.
    statements = F.transform(F.reverse(F.split("marked", _MARK)), _statement)
    named = F.transform(
        statements,
        lambda s: F.struct(
            s["start_line"].alias("start_line"), s["text"].alias("text"),
            F.when(python, _python_name(s["text"])).otherwise(_script_name(s["text"], typescript)).alias("found"),
        ),
    )
    parts = marked.select("repo_id", "file_id", "language", F.posexplode(named).alias("ordinal", "s")).select(
        "repo_id", "file_id", "language", "ordinal", "s.start_line", "s.text", "s.found"
    ).where("start_line IS NOT NULL AND found IS NOT NULL")

    text, found = F.col("text"), F.col("found")
    source = F.when(python | ~_starts(text, "export"), text).when(
        text.rlike(_JS_ARROW), F.regexp_replace(F.regexp_replace(text, _ARROW_PREFIX, ""), r";\s*$", "")
    ).otherwise(F.regexp_replace(text, _EXPORT_PREFIX, ""))
    symbols = parts.select(
        "repo_id", "file_id", "language", "ordinal", "start_line",
        F.when(python, _python_kind(text, found)).otherwise(_script_kind(text, found, typescript)).alias("kind"),
        F.when(found == "", F.lit("<anonymous>")).otherwise(found).alias("name"),
        (F.col("start_line") + F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("int").alias("end_line"),
        source.alias("source_code"),
    ).where(F.col("kind").isNotNull())
    return complexity(symbols).select(
        "repo_id",
        F.sha2(F.concat_ws("\0", "repo_id", "file_id", F.col("start_line").cast("string")), 256).alias("symbol_id"),
        "file_id", "kind", "name", "start_line", "end_line", "source_code", "cyclomatic_complexity", "ordinal",
    )
