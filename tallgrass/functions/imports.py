"""Import statements of a source text, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import RUNTIME, TYPE_ONLY, WHITE
from .names import builtin, package_root

S, QUOTE, PATH = f"[{WHITE}]", "['\"]", "['\"][^'\"]+['\"]"
WORD_END, WORD_START = r"(?!\w)", r"(?<!\w)"

# What a comment and the three kinds of statement look like.
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
LINE_COMMENT = r"//[\x00-\x09\x0B\x0C\x0E-\x{2027}\x{202A}-\x{10FFFF}]*"  # to the end of the line; Java reads the ranges six times as fast as [^...]
GENERAL = (
    rf"(?=[ir])(?:import(?!{S}+type{WORD_END})(?!{S}*\{{[^}}]*?{WORD_START}type{S}+\w+{WORD_END}[^}}]*\}})"
    rf"(?:{S}+[\w*{WHITE}{{}},]*{S}+from{S}+)?{S}*{PATH}"
    rf"|require{S}*\({S}*{PATH}{S}*\))"
)
TYPES = rf"import{S}+type{S}+[^'\"]+from{S}+{PATH}"
MIXED = rf"import{S}*\{{[^}}]+\}}{S}*from{S}+{PATH}"
# End of the fixed values.

#: Stands around matches while they are cut out; in a source it is taken for its neighbour U+FFFE.
MARK, MARK_TO = "\uffff", "\ufffe"
NONE = "array<string>"
#: What extraction adds to the columns of files.
COLUMNS = ["package", "import_type", "line", "import_statement", "pass", "match_seq"]


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{S}+|{S}+\z", "")


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def cut_out(code: Column, pattern: str) -> Column:
    """What lies between the matches of a pattern, and the matches, in turn: one scan marks them, a split cuts at the marks."""
    return F.split(F.regexp_replace(code, pattern, f"{MARK}$0{MARK}"), MARK, -1)


def strip_comments(code: Column) -> Column:
    """Block comments become their newlines, then line comments go; lines keep their numbers."""
    clean = F.when(code.contains(MARK), F.translate(code, MARK, MARK_TO)).otherwise(code)
    parts = F.transform(cut_out(clean, BLOCK_COMMENT), lambda x, i: F.when(i % 2 == 1, F.regexp_replace(x, r"[^\n]+", "")).otherwise(x))
    return F.regexp_replace(F.when(code.contains("/*"), F.array_join(parts, "")).otherwise(clean), LINE_COMMENT, "")


def line_at(text: Column, offset: Column) -> Column:
    """The 1-based line of a 0-based offset: only \\n parts lines; past the end it is the last."""
    return F.lit(1) + newlines(F.substring(text, F.lit(1), offset))


#: Parts whose newlines are added up together. Appending to an array copies it, so that long arrays are added up block by block.
BLOCK = 128


def running(numbers: Column, start: Column) -> Column:
    """start, and start plus each of the leading sums but the last: quadratic, for short arrays."""
    first = F.struct(F.array().cast("array<int>").alias("sums"), start.alias("now"))
    step = lambda acc, n: F.struct(F.concat(acc["sums"], F.array(acc["now"])).alias("sums"), (acc["now"] + n).alias("now"))
    return F.aggregate(numbers, first, step)["sums"]


def summed(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def lines_of(counts: Column) -> Column:
    """The line on which each part begins, from the parts' newlines. Blocks of blocks of parts are added up, each on its own, so that a file of any number of
    imports takes time in proportion to them."""

    def blocks(numbers: Column, size: int) -> Column:
        count = F.floor((F.size(numbers) + (size - 1)) / size).cast("int")
        return F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: F.slice(numbers, (k - 1) * size + 1, size))

    def added(numbers: Column, start: Column, sizes: tuple[int, ...]) -> Column:
        if not sizes:
            return running(numbers, start)
        cut = blocks(numbers, sizes[0])
        return F.flatten(F.zip_with(cut, running(F.transform(cut, summed), start), lambda x, at: added(x, at, sizes[1:])))

    return F.when(F.size(counts) <= BLOCK, running(counts, F.lit(1))).otherwise(added(counts, F.lit(1), (BLOCK * BLOCK, BLOCK)))


def specifier_type(statement: Column) -> Column:
    """Of a statement with braces: runtime if any name in them lacks `type `, else type-only; null without `type `."""
    names = F.regexp_extract(statement, r"\{([^}]+)\}", 1)
    plain = F.exists(F.split(names, ",", -1), lambda x: ~js_trim(x).contains("type "))
    return F.when(names.contains("type "), F.when(plain, RUNTIME).otherwise(TYPE_ONLY))


def extract_imports(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per import found: all columns of files but the content, and package, import_type, line,
    import_statement, pass, match_seq. Nulls and files without imports give no rows.

    Comments are stripped once; the three passes read the same text and their matches are exploded together, so that a
    file is one row of one narrow stage."""
    others = [c for c in files.columns if c != content]
    code = F.col("_code")
    passes = {1: (GENERAL, code.contains("import") | code.contains("require")), 2: (TYPES, code.contains("type")), 3: (MIXED, code.contains("type "))}
    stripped = files.select(*others, strip_comments(F.col(content)).alias("_code"))
    # each pattern runs once over a file that can have it; its parts are held in columns, as the lambda below would cut again for each match
    found = stripped.select(*others, *(F.when(needed, cut_out(code, p)).otherwise(F.array().cast(NONE)).alias(f"_f{n}") for n, (p, needed) in passes.items()))
    counted = found.select("*", *(F.transform(f"_f{n}", newlines).alias(f"_n{n}") for n in passes))
    placed = counted.select(*found.columns, *(lines_of(F.col(f"_n{n}")).alias(f"_l{n}") for n in passes))

    def held(value: Column, use) -> Column:
        """use(value), where the value is computed once however often it is used: an alias would be copied into every use of it."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def match(n: int, statement: Column, i: Column) -> Column:
        path = F.regexp_extract(statement, rf"{QUOTE}([^'\"]+){QUOTE}{S}*\)?\z", 1)
        kind = {1: F.lit(RUNTIME), 2: F.lit(TYPE_ONLY), 3: specifier_type(statement)}[n]
        return F.struct(
            held(path, package_root).alias("package"), kind.alias("import_type"), F.get(F.col(f"_l{n}"), i).alias("line"),
            statement.alias("import_statement"), F.lit(n).alias("pass"), F.floor(i / 2).cast("int").alias("match_seq"),
        )

    def matches(n: int) -> Column:
        every = F.array_compact(F.transform(f"_f{n}", lambda m, i: F.when(i % 2 == 1, match(n, m, i))))
        return F.filter(every, lambda m: m["package"].isNotNull() & ~builtin(m["package"]) & m["import_type"].isNotNull())

    # statements begin with a letter and end with a quote or a bracket, so that there is no white space to trim
    return placed.select(*others, F.explode(F.concat(*map(matches, passes))).alias("_m")).select(*others, *(f"_m.{c}" for c in COLUMNS))
