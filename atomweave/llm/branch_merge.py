"""Three-way merge of two branches of a table of texts, by operational transformation.

A branch says what it does to a base row as operations over base's indices, in one struct: ``row`` (retain or delete),
``columns`` (a struct with an operation for each plain column), ``head`` (lines inserted before the first) and
``lines``, whose element i is the operation on base line i: its ``kind`` (retain, delete or replace with ``text``) and the
lines it ``insert``s into the gap after it. Rows that a branch inserts are a table of their own.

``transform`` takes the pair of concurrent operations that two branches have at one base index and gives the one
operation over base that stands for both: the change that one of them makes, or that both make alike, else base's own state, with how
the pair came out. ``compose`` applies operations to base's lines. As indices are base's, no operation moves another.

Everything is built-in functions on the row itself: a base row and what both branches do to it need no shuffle, so neither a hot
column value nor a long text brings rows together. Only inserted rows are grouped, by id, as two partial aggregates.

Nulls in plain columns and texts are empty before anything else; an empty text is one empty line. A null operation, and one
missing at a list's end, retains. Operations beyond base's last line are refused. Rows that repeat an id, and rows without one, are
merged each for itself. An inserted row whose id a base row has stays a row of its own. Several different
rows inserted under one id are a conflict, whichever branch they are from. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETAIN, DELETE, REPLACE = "retain", "delete", "replace"
OPERATION = "struct<kind: string, text: string, insert: array<string>>"
COUNTS = ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


def operation(kind: Column, text: Column, insert: Column) -> Column:
    """What a branch does at a base index."""
    return F.struct(kind.alias("kind"), text.alias("text"), insert.alias("insert"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _kind(op: Column) -> Column:
    return F.coalesce(op["kind"], F.lit(RETAIN))


def _inserts(lines: Column) -> Column:
    return F.coalesce(F.size(lines), F.lit(0)) > 0


def transform(left: Column, right: Column) -> Column:
    """One operation over base for a concurrent pair; ``line`` and ``gap`` say how the line's change and the gap's came out.

    line: null (no change), clean, edit_edit or edit_delete. gap: null, clean or insert_insert.
    """
    a, b = _kind(left), _kind(right)
    alike = (a == b) & left["text"].eqNullSafe(right["text"])
    none, one = (a == RETAIN) & (b == RETAIN), (a == RETAIN) | (b == RETAIN)
    keep = F.when((b == RETAIN) | alike, F.struct(a.alias("kind"), left["text"].alias("text"))).when(a == RETAIN, F.struct(b.alias("kind"), right["text"].alias("text")))
    kept = F.coalesce(keep, F.struct(F.lit(RETAIN).alias("kind"), F.lit(None).cast("string").alias("text")))
    line = F.when(none, F.lit(None).cast("string")).when(one | alike, F.lit("clean")).when((a == DELETE) | (b == DELETE), F.lit("edit_delete")).otherwise(F.lit("edit_edit"))
    insert, gap = transform_inserts(left["insert"], right["insert"])
    return F.struct(kept["kind"].alias("kind"), kept["text"].alias("text"), insert.alias("insert"), line.alias("line"), gap.alias("gap"))


def transform_inserts(left: Column, right: Column) -> tuple[Column, Column]:
    """Lines inserted into one gap by two branches: what stands for both, and how it came out."""
    a, b = _inserts(left), _inserts(right)
    alike = left == right
    lines = F.when(a & ~b, left).when(b & ~a, right).when(a & b & alike, left)
    return lines, F.when(a & b & ~alike, F.lit("insert_insert")).when(a | b, F.lit("clean"))


def compose(lines: Column, operations: Column, head: Column | None = None) -> Column:
    """Base's lines with operations applied: an array of lines."""
    nothing = F.array().cast("array<string>")

    def applied(line: Column, op: Column) -> Column:
        own = F.when(_kind(op) == DELETE, nothing).when(_kind(op) == REPLACE, F.array(op["text"])).otherwise(F.array(line))
        return F.concat(own, F.coalesce(op["insert"], nothing))

    body = F.flatten(F.zip_with(lines, operations, applied))
    return body if head is None else F.concat(F.coalesce(head, nothing), body)


def _number(operations: Column, field: str, outcome: str) -> Column:
    return F.size(F.filter(operations, lambda x: x[field] == outcome)).cast("long")


def _changes(operations: Column) -> Column:
    return F.coalesce(F.exists(operations, lambda x: (_kind(x) != RETAIN) | _inserts(x["insert"])), F.lit(False))


def merge_rows(rows: DataFrame, key: str = "doc_id", columns: tuple[str, ...] = ("lang", "source"), text: str = "text", left: str = "left", right: str = "right") -> DataFrame:
    """(key, *columns, text, n_clean, n_edit_edit, n_edit_delete, n_insert_insert): every base row with both branches merged.

    ``left`` and ``right`` name the branches' structs. A row that is gone has nulls but for its key. A row drop counts alone: it is
    an edit-delete conflict that leaves base's row if the other branch keeps and changes the row, else clean.
    """
    sides = ("l", "r")
    names = [f"c{i}" for i in range(len(columns))]
    empty = F.array().cast(f"array<{OPERATION}>")
    base = rows.select(
        F.col(key).alias("key"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in zip(columns, names)),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        lines_of(F.col(text)).alias("lines"),
        *(F.col(c).alias(s) for c, s in zip((left, right), sides)),
    )
    for s in sides:
        n = F.size(F.coalesce(f"{s}.lines", empty))
        base = base.withColumn(f"{s}_ops", F.when(n > F.size("lines"), F.raise_error(F.lit("operations beyond base's last line")).cast(f"array<{OPERATION}>")).otherwise(F.coalesce(f"{s}.lines", empty)))
    base = base.withColumn("ops", F.zip_with(F.zip_with("lines", "l_ops", lambda _, o: o), "r_ops", transform))
    head, head_gap = transform_inserts(F.col("l.head"), F.col("r.head"))
    base = base.withColumn("head", head).withColumn("head_gap", head_gap).withColumn("merged", compose(F.col("lines"), F.col("ops"), F.col("head")))

    value = {}  # columns merge by value
    for s in sides:
        for c, n in zip(columns, names):
            op = F.col(f"{s}.columns.{c}")
            value[s, n] = F.when(_kind(op) == REPLACE, F.coalesce(op["text"], F.lit(""))).when(_kind(op) == DELETE, F.lit("")).otherwise(F.col(n))
    some = {(s, n): value[s, n] != F.col(n) for s, n in value}
    clash = {n: some["l", n] & some["r", n] & (value["l", n] != value["r", n]) for n in names}
    plain = {n: F.when(clash[n], F.col(n)).when(some["l", n], value["l", n]).otherwise(value["r", n]) for n in names}
    whole = lambda cs: sum((c.cast("long") for c in cs), F.lit(0).cast("long"))
    counts = {
        "n_clean": whole([(some["l", n] | some["r", n]) & ~clash[n] for n in names]) + _number(F.col("ops"), "line", "clean") + _number(F.col("ops"), "gap", "clean") + F.coalesce((F.col("head_gap") == "clean").cast("long"), F.lit(0)),
        "n_edit_edit": whole(clash.values()) + _number(F.col("ops"), "line", "edit_edit"),
        "n_edit_delete": _number(F.col("ops"), "line", "edit_delete"),
        "n_insert_insert": _number(F.col("ops"), "gap", "insert_insert") + F.coalesce((F.col("head_gap") == "insert_insert").cast("long"), F.lit(0)),
    }
    changed = {s: F.lit(False) for s in sides}
    for s in sides:
        for n in names:
            changed[s] = changed[s] | some[s, n]
        changed[s] = changed[s] | _changes(F.col(f"{s}_ops")) | _inserts(F.col(f"{s}.head"))
    drop = {s: F.coalesce(F.col(f"{s}.row") == DELETE, F.lit(False)) for s in sides}
    fate = (
        F.when(drop["l"] & drop["r"], "gone")
        .when(drop["l"] | drop["r"], F.when(F.when(drop["l"], changed["r"]).otherwise(changed["l"]), "base").otherwise("gone"))
        .otherwise("merged")
    )
    out = base.select(
        "key",
        fate.alias("fate"),
        "text",
        F.array_join("merged", "\n").alias("merged_text"),
        *(x for n in names for x in (F.col(n), plain[n].alias(f"m_{n}"))),
        *(c.alias(n) for n, c in counts.items()),
    )
    state = lambda base, merged: F.when(F.col("fate") == "merged", F.col(merged)).when(F.col("fate") == "base", F.col(base))
    alone = {"n_clean": "gone", "n_edit_delete": "base"}
    return out.select(
        F.col("key").alias(key),
        *(state(n, f"m_{n}").alias(c) for c, n in zip(columns, names)),
        state("text", "merged_text").alias(text),
        *(F.when(F.col("fate") == "merged", F.col(c)).otherwise((F.col("fate") == alone.get(c, "")).cast("long")).alias(c) for c in COUNTS),
    )


def merge_inserted(inserted: DataFrame, key: str = "doc_id", columns: tuple[str, ...] = ("lang", "source"), text: str = "text") -> DataFrame:
    """The same columns as ``merge_rows`` for the rows that branches insert: kept if all under an id are alike, else absent and a conflict."""
    names = [*columns, text]
    row = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"v{i}") for i, c in enumerate(names)))
    found = inserted.select(F.col(key).alias("key"), row.alias("row")).groupBy("key").agg(F.min("row").alias("row"), F.max("row").alias("other"))
    alike = F.col("row") == F.col("other")
    return found.select(
        F.col("key").alias(key),
        *(F.when(alike, F.col(f"row.v{i}")).alias(c) for i, c in enumerate(names)),
        alike.cast("long").alias("n_clean"),
        *(F.lit(0).cast("long").alias(c) for c in COUNTS[1:3]),
        (~alike).cast("long").alias("n_insert_insert"),
    )


def merge_branches(base: DataFrame, left: DataFrame, right: DataFrame, inserted: DataFrame, key: str = "doc_id", columns: tuple[str, ...] = ("lang", "source"), text: str = "text") -> DataFrame:
    """Merge two branches that are tables of their own: (key, branch), at most one row for an id, and the rows they insert."""
    of = lambda t, name: t.select(F.col(key).alias(f"{name}_key"), F.struct(*(F.col(f"branch.{f}").alias(f) for f in ("row", "columns", "head", "lines"))).alias(name))
    rows = base.select(key, *columns, text)
    for t, name in ((left, "left"), (right, "right")):
        rows = rows.join(of(t, name), F.col(key) == F.col(f"{name}_key"), "left").drop(f"{name}_key")
    return merge_rows(rows, key, columns, text).unionByName(merge_inserted(inserted, key, columns, text))
