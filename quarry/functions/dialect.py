"""Functions under names or meanings that Spark doesn't have, put into Spark's SQL before it is parsed.

The table below says how a call is written for Spark; {0}, {1} stand for its arguments. Calls that Spark has alike aren't
listed. A name with several forms is told apart by its number of arguments.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from quarry.plans.errors import QuarryError

_MICROS = "unix_micros(cast({} as timestamp))"
_BIN = "timestamp_micros({ts} - pmod({ts} - {origin}, unix_micros(timestamp_seconds(0) + {{0}})))"
_GCD = "aggregate(sequence(1, 92), named_struct('x', abs(cast({0} as bigint)), 'y', abs(cast({1} as bigint))), (s, i) -> if(s.y = 0, s, named_struct('x', s.y, 'y', try_mod(s.x, s.y)))).x"
_BITS = {"md5": "md5(cast({0} as binary))", "sha224": "sha2({0}, 224)", "sha256": "sha2({0}, 256)", "sha384": "sha2({0}, 384)", "sha512": "sha2({0}, 512)"}
#: Names of columnar types and Spark's for them (fixed values).
ARROW = {
    "boolean": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double",
    "utf8": "string", "largeutf8": "string", "binary": "binary", "date32": "date",
}


def _plain(text: str) -> str:
    return text.strip().strip("'").lower()


def _of(table: dict[str, str], what: str) -> Callable[[list[str]], str]:
    def write(args: list[str]) -> str:
        if _plain(args[1]) not in table:
            raise QuarryError(f"UNKNOWN_{what}", name=args[1])
        return table[_plain(args[1])].format(*args)

    return write


#: (name, number of arguments; -1 for any) -> Spark's form.
CALLS: dict[tuple[str, int], str | Callable[[list[str]], str]] = {
    ("approx_distinct", 1): "approx_count_distinct({0})",
    ("approx_median", 1): "percentile_approx({0}, 0.5D)",
    ("approx_percentile_cont", 2): "percentile_approx({0}, {1})",
    ("approx_percentile_cont_with_weight", 3): "percentile({0}, {2}, {1})",
    ("starts_with", 2): "startswith({0}, {1})",
    ("ends_with", 2): "endswith({0}, {1})",
    ("strpos", 2): "instr({0}, {1})",
    ("substr_index", 3): "substring_index({0}, {1}, {2})",
    ("to_hex", 1): "lower(hex({0}))",
    ("concat", -1): lambda args: f"concat_ws('', {', '.join(args)})",  # passes over nulls
    ("regexp_match", 2): "if(regexp_like({0}, {1}), array(regexp_extract({0}, {1}, 0)), null)",
    **{(name, 1): form for name, form in _BITS.items()},
    ("digest", 2): _of(_BITS, "DIGEST"),
    ("encode", 2): _of({"hex": "lower(hex(cast({0} as binary)))", "base64": "base64(cast({0} as binary))"}, "ENCODING"),
    ("decode", 2): _of({"hex": "unhex({0})", "base64": "unbase64({0})"}, "ENCODING"),
    ("log", 1): "log10({0})",
    ("trunc", 1): "(sign({0}) * floor(abs({0})))",
    ("gcd", 2): _GCD,
    ("lcm", 2): f"if({{0}} = 0 or {{1}} = 0, 0, abs({{0}} * ({{1}} div {_GCD})))",
    ("iszero", 1): "({0} = 0)",
    ("random", 0): "rand()",
    ("today", 0): "current_date()",
    ("datepart", 2): "date_part({0}, {1})",
    ("date_bin", 2): _BIN.format(ts=_MICROS.format("{1}"), origin="0"),
    ("date_bin", 3): _BIN.format(ts=_MICROS.format("{1}"), origin=_MICROS.format("{2}")),
    ("to_unixtime", 1): "unix_seconds(cast({0} as timestamp))",
    ("from_unixtime", 1): "timestamp_seconds({0})",
    ("to_timestamp_seconds", 1): "timestamp_seconds({0})",
    ("to_timestamp_millis", 1): "timestamp_millis({0})",
    ("to_timestamp_micros", 1): "timestamp_micros({0})",
    ("to_timestamp_nanos", 1): "timestamp_micros(({0}) div 1000)",
    ("to_char", 2): "date_format({0}, {1})",
    ("to_local_time", 1): "cast({0} as timestamp_ntz)",
    ("arrow_typeof", 1): "typeof({0})",
    ("arrow_cast", 2): _of({k: f"cast({{0}} as {v})" for k, v in ARROW.items()}, "TYPE"),
    ("get_field", 2): lambda args: f"({args[0]}).`{args[1].strip().strip(chr(39))}`",
    ("make_array", -1): lambda args: f"array({', '.join(args)})",
    ("array_length", 1): "size({0})",
    ("list_extract", 2): "get({0}, {1} - 1)",
}
_NAMES = {name for name, _ in CALLS}


def _similar(pattern: str) -> str:
    """A SIMILAR TO pattern as a regular expression for a whole text."""
    out = re.sub(r"([.^$])", r"\\\\\1", pattern[1:-1]).replace("%", ".*").replace("_", ".")
    return f"'^(?:{out})$'"


def infix(text: str) -> str:
    """Operators that Spark lacks: ~, !~, ~* and !~* (regular expressions), SIMILAR TO, ->> and -> (a JSON member of a column), CROSS
    and OUTER APPLY."""
    from quarry.plans.statements import Cursor

    if not re.search(r"~|->|\bSIMILAR\b|\bAPPLY\b", text, re.I):
        return text
    c, out, at, column = Cursor(text), [], 0, None

    def put(first, last, what: str) -> None:
        nonlocal at
        out.extend([text[at : first.start], what])
        at = last.end

    while c.at < len(c.tokens):
        t = c.tokens[c.at]
        after = c.tokens[c.at + 1] if c.at + 1 < len(c.tokens) else None
        if t.kind == "name" and t.word not in ("SIMILAR", "CROSS", "OUTER"):
            first = c.at
            c.name()
            column = (c.tokens[first], c.tokens[c.at - 1])
            continue
        if c.word() in ("!", "~"):
            no, c.at = c.word() == "!", c.at + (c.word() == "!")
            if c.accept("~"):
                fold = c.accept("*")
                last = c.tokens[c.at] if c.at < len(c.tokens) else None
                if last is not None and last.kind == "text" and column is not None:
                    put(t, last, f"{'NOT ' * no}RLIKE '{'(?i)' * fold}{last.text[1:-1]}'")
                    c.at += 1
        elif t.word == "SIMILAR" and c.word(1) == "TO" and c.tokens[c.at + 2 : c.at + 3] and c.tokens[c.at + 2].kind == "text":
            put(t, c.tokens[c.at + 2], f"RLIKE {_similar(c.tokens[c.at + 2].text)}")
            c.at += 3
        elif t.word in ("CROSS", "OUTER") and c.word(1) == "APPLY":
            put(t, c.tokens[c.at + 1], "CROSS JOIN LATERAL" if t.word == "CROSS" else "LEFT JOIN LATERAL")
            c.at += 2
        elif t.text == "-" and after is not None and after.text == ">" and after.start == t.end and column is not None and column[1].end <= t.start:
            c.at += 2 + (c.word(2) == ">")
            member = c.tokens[c.at] if c.at < len(c.tokens) else None
            if member is not None and member.kind == "text":
                put(column[0], member, f"get_json_object({text[column[0].start : column[1].end]}, '$.{member.text[1:-1]}')")
                c.at += 1
        else:
            c.at += 1
        column = None
    return "".join(out) + text[at:]


def clauses(text: str) -> str:
    """QUALIFY as a filter around its query, whose condition is worked out as a column; PREWHERE as the first part of WHERE."""
    from quarry.plans.statements import Cursor

    if not re.search(r"\b(?:QUALIFY|PREWHERE)\b", text, re.I):
        return text
    # queries in parentheses first
    c, out, at = Cursor(text), [], 0
    while c.at < len(c.tokens):
        if c.word() == "(" and c.word(1) in ("SELECT", "WITH"):
            first = c.tokens[c.at + 1].start
            inner = c.group()
            out += [text[at:first], clauses(inner)]
            at = first + len(inner)
        else:
            c.at += 1
    text = "".join(out) + text[at:]
    ends = (("GROUP", "BY"), ("HAVING",), ("WINDOW",), ("QUALIFY",), ("ORDER", "BY"), ("LIMIT",), ("OFFSET",), ("UNION",), ("INTERSECT",), ("EXCEPT",))
    c = Cursor(text)
    before = c.until(("PREWHERE",))
    if c.accept("PREWHERE"):
        one = c.until(("WHERE",), *ends)
        two = c.until(*ends) if c.accept("WHERE") else ""
        text = f"{before} WHERE ({one})" + (f" AND ({two})" if two else "") + (f" {c.rest()}" if c.rest() else "")
    c = Cursor(text)
    c.until(("SELECT",))
    head = text[: c.tokens[c.at].start] if c.at < len(c.tokens) else text
    query = c.until(("QUALIFY",))
    if not c.accept("QUALIFY"):
        return text
    condition = c.until(*ends[4:])
    inner = Cursor(query)
    select = inner.until(("FROM",))
    if inner.tokens[1].word == "DISTINCT":
        raise QuarryError("UNSUPPORTED_CLAUSE", text="DISTINCT with QUALIFY")
    return f"{head}SELECT * EXCEPT (__kept) FROM ({select}, ({condition}) AS __kept {inner.rest()}) WHERE __kept {c.rest()}"


#: Aggregates whose state is an object; a query that also counts distinct values would keep one for each of these values.
_OBJECTS = r"\b(?:percentile\w*|median|mode|approx_\w+|collect_\w+|array_agg|listagg|string_agg|hll_\w+)\s*\("


def apart(text: str) -> str:
    """A query of one row that has count(distinct ..) beside aggregates with large states, with the count as a query of its own.

    Left as it is: what has groups, sets or several rows, calls that may differ from one evaluation to the next, items without a name.
    """
    from quarry.plans.statements import Cursor, listed

    if not (re.search(r"\bcount\s*\(\s*distinct\b", text, re.I) and re.search(_OBJECTS, text, re.I)):
        return text
    if re.search(r"[?]|\b(?:GROUP|HAVING|UNION|INTERSECT|EXCEPT|MINUS|ORDER|LIMIT|OFFSET|WINDOW|OVER|FILTER|TABLESAMPLE|LATERAL|DISTINCT\s+FROM|rand\w*|uuid|shuffle|now|current_\w+|monotonically_\w+)\b", text, re.I):
        return text
    c = Cursor(text)
    c.until(("SELECT",))
    if not c.accept("SELECT") or c.word() in ("DISTINCT", "ALL"):
        return text
    first = c.tokens[c.at].start
    items = c.until(("FROM",))
    if c.word() != "FROM" or re.search(r"\bSELECT\b", items, re.I):
        return text
    source, out = c.rest(), []
    for item in listed(items):
        i, at, parts = Cursor(item), 0, []
        while i.at < len(i.tokens):
            t = i.tokens[i.at]
            i.at += 1
            if t.word == "COUNT" and i.word() == "(" and i.word(1) == "DISTINCT":
                i.group()
                end = i.tokens[i.at - 1].end
                parts += [item[at : t.start], f"(SELECT {item[t.start:end]} {source})"]
                at = end
        if parts and not any(t.word == "AS" and t.depth == i.tokens[0].depth for t in i.tokens):
            return text  # its name comes from its text
        out.append("".join(parts) + item[at:])
    return f"{text[:first]}{', '.join(out)} {source}"


def spelled(text: str) -> str:
    """A query with every call of the table in Spark's form."""
    from quarry.plans.statements import Cursor, listed

    if not re.search(rf"\b(?:{'|'.join(_NAMES)})\s*\(", text, re.I):
        return text
    c, out, at = Cursor(text), [], 0
    while c.at < len(c.tokens):
        t = c.tokens[c.at]
        c.at += 1
        if t.word.lower() not in _NAMES or c.word() != "(" or (c.at > 1 and c.tokens[c.at - 2].text == "."):
            continue
        args = [spelled(x) for x in listed(c.group())]
        form = CALLS.get((t.text.lower(), len(args)), CALLS.get((t.text.lower(), -1)))
        if form is not None:
            put = form(args) if callable(form) else form.format(*args)
        else:
            put = f"{t.text}({', '.join(args)})"
        out += [text[at : t.start], put]
        at = c.tokens[c.at - 1].end
    return "".join(out) + text[at:]
