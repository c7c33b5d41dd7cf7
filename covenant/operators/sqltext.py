"""Names in SQL texts (TXT-9, strict): what a statement refers to, clause by clause.

A text is cut into tokens by one alternation, so words inside literals and
comments are never seen. One fold over the tokens keeps the clause of every open
parenthesis and gives each name its role: table, alias, qualifier, function,
column. Findings are columns that no table offers and no alias defines,
qualifiers that are neither a table nor an alias, and, where the tables are
known, tables that are not among them. Nothing is parsed or planned: a text that
is no SQL has roles too, if odd ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: comment | literal | quoted name | word | number | sign
TOKEN = (r"(?s)--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`"
         r"|[A-Za-z_][A-Za-z_0-9]*|[0-9]+(?:\.[0-9]+)?|\S")

#: Words that are never names, by the clause that they open ('' for none).
CLAUSES = {"WITH": "with", "SELECT": "select", "FROM": "from", "JOIN": "from", **dict.fromkeys(
    ("WHERE", "ON", "USING", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "QUALIFY", "UNION", "INTERSECT", "EXCEPT", "VALUES"), "other")}
WORDS = ("ALL AND ANY AS ASC BETWEEN BY CASE CROSS CURRENT_DATE CURRENT_TIMESTAMP DESC DISTINCT ELSE END ESCAPE EXISTS FALSE FIRST FOLLOWING FULL "
         "ILIKE IN INNER INTERVAL IS LAST LATERAL LEFT LIKE NATURAL NOT NULL NULLS OR OUTER OVER PARTITION PRECEDING RANGE RECURSIVE RIGHT ROW ROWS "
         "SEMI ANTI SOME THEN TRUE UNBOUNDED WHEN WINDOW FILTER").split()
STATE = "struct<stack:array<string>,prev:string,kind:string,items:array<struct<name:string,role:string>>>"


def tokens(sql: Column) -> Column:
    """The tokens of a text without its comments."""
    found = F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~F.startswith(t, F.lit("--")) & ~(F.startswith(t, F.lit("/*")) & F.endswith(t, F.lit("*/")) & (F.length(t) > 3)))


def _array(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _kinds(found: Column) -> Column:
    """array<struct<t, first, name, kind>> of tokens: what does not depend on those around them, computed once a token."""
    def begin(t: Column) -> Column:
        return _let(F.struct(t.alias("t"), F.substring(t, 1, 1).alias("first")), named)

    def named(x: Column) -> Column:
        quoted = x["first"].isin('"', "`") & (F.length(x["t"]) > 1)
        name = F.upper(F.when(quoted, x["t"].substr(F.lit(2), F.length(x["t"]) - 2)).otherwise(x["t"]))
        return _let(F.struct(x["t"].alias("t"), x["first"].alias("first"), quoted.alias("quoted"), name.alias("name")), kind)

    def kind(x: Column) -> Column:
        word = F.rlike(x["first"], F.lit("[A-Za-z_]"))
        k = (F.when(x["quoted"], "name").when(word, F.when(x["name"].isin(*CLAUSES, *WORDS), "keyword").otherwise("name")).when(x["first"] == "'", "literal")
             .when(F.rlike(x["first"], F.lit("[0-9]")), "number").otherwise("sign"))
        return F.struct(x["t"].alias("t"), x["first"].alias("first"), x["name"].alias("name"), k.alias("kind"))

    return F.transform(found, begin)


def roles(sql: Column) -> Column:
    """array<struct<name, role>> of all names, upper-cased, in order."""
    clause_of = F.create_map(*[F.lit(x) for kv in CLAUSES.items() for x in kv])
    none = F.array().cast("array<struct<name:string,role:string>>")
    start = F.struct(F.array(F.lit("other")).alias("stack"), F.lit("").alias("prev"), F.lit("").alias("kind"), none.alias("items")).cast(STATE)

    def step(s: Column, x: Column) -> Column:
        t, first, name, kind, p, pk = x["t"], x["first"], x["name"], x["kind"], s["prev"], s["kind"]
        top = F.element_at(s["stack"], -1)
        last = F.try_element_at(s["items"], F.lit(-1))
        # a name that follows a finished expression renames it
        after = pk.isin("name", "number", "literal") | (p == ")") | (p == "END")
        role = (F.when(p == ".", F.when(last["role"] == "table", "table").otherwise("column"))
                .when(p == "AS", F.when(top == "with", "table").otherwise("alias"))
                .when((top == "with") & p.isin("WITH", "RECURSIVE", ","), "cte")
                .when((top == "from") & p.isin("FROM", "JOIN", ",", "LATERAL"), "table")
                .when((top == "from") & after, "alias")
                .when(pk == "literal", "unit")
                .when((top == "select") & after, "alias")
                .otherwise("word"))
        # what follows tells what the name before it was
        told = F.when(pk == "name", F.when((t == "(") & (last["role"] == "word"), "function").when(
            (t == ".") & last["role"].isin("word", "alias"), "qualifier").when((first == "'") & (last["role"] == "word"), "type"))
        items = (F.when(kind == "name", F.concat(s["items"], F.array(F.struct(name.alias("name"), role.alias("role")))))
                 .when(told.isNotNull(), F.concat(F.slice(s["items"], 1, F.greatest(F.size(s["items"]) - 1, F.lit(0))),
                                                  F.array(F.struct(last["name"].alias("name"), told.alias("role"))))).otherwise(s["items"]))
        opened = F.when(kind == "keyword", clause_of[name])
        below = F.slice(s["stack"], 1, F.greatest(F.size(s["stack"]) - 1, F.lit(0)))
        stack = (F.when(t == "(", F.concat(s["stack"], F.array(F.lit("other"))))
                 .when((t == ")") & (F.size(s["stack"]) > 1), below)
                 .when(opened.isNotNull(), F.concat(below, F.array(opened))).otherwise(s["stack"]))
        return F.struct(stack.alias("stack"), F.when(kind == "name", t).otherwise(F.upper(t)).alias("prev"), kind.alias("kind"), items.alias("items"))

    return F.aggregate(_kinds(tokens(sql)), start, step)["items"]


def lint_names(sql: Column, available: Sequence[str], tables: Sequence[str] | None = None) -> Column:
    """TXT-9 strict: sorted distinct findings as ``kind NAME`` texts; a null text has null findings."""
    offered = _array([c.upper() for c in available])
    known = _array([t.upper() for t in tables]) if tables is not None else None

    def findings(items: Column) -> Column:
        named = lambda *kinds: F.transform(F.filter(items, lambda i: i["role"].isin(*kinds)), lambda i: i["name"])
        aliases, made = named("alias"), named("cte")
        bad = F.filter(items, lambda i: F.when(i["role"].isin("word", "column"), ~F.array_contains(offered, i["name"]) & ~F.array_contains(aliases, i["name"]))
                       .when(i["role"] == "qualifier", ~F.array_contains(aliases, i["name"]) & ~F.array_contains(named("table"), i["name"])
                             & ~F.array_contains(made, i["name"]))
                       .when(i["role"] == "table", (~F.array_contains(known, i["name"]) & ~F.array_contains(made, i["name"])) if known is not None else F.lit(False))
                       .otherwise(F.lit(False)))
        text = F.transform(bad, lambda i: F.concat_ws(" ", F.when(i["role"].isin("word", "column"), "column").otherwise(i["role"]), i["name"]))
        return F.array_sort(F.array_distinct(text))

    # the roles are computed once for all uses
    return F.transform(F.array(roles(sql)), findings)[0]
