"""Go text formatting rules as Spark SQL expressions.

* ``go_float_sql`` — Go ``%g`` for float64: shortest round-trip digits,
  exponent form when the decimal exponent is < -4 or >= 6, exponent with at
  least two digits, no trailing ``.0``; ``NaN``, ``+Inf``, ``-Inf``, ``-0``.
  The shortest digits come from Spark's own double-to-string cast, which on
  JDK 17 is not always shortest in the last digit (known, accepted deviation).
* ``go_quote_sql`` — Go ``%q`` for strings (used inside validation messages).

The generators return SQL text over an input SQL expression, so they nest
inside higher-order functions and build as one JVM call. Intermediate values
are bound once through a one-element ``transform`` (a "let").
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Go's short escapes for control characters in %q.
GO_SHORT_ESCAPES = {7: "a", 8: "b", 9: "t", 10: "n", 11: "v", 12: "f", 13: "r"}


def let_sql(value: str, var: str, body: str) -> str:
    return f"get(transform(array({value}), {var} -> {body}), 0)"


def _format_digits_sql(z: str) -> str:
    """struct(d = significant digits, p = decimal point position) -> %g text."""
    d, p = f"{z}.d", f"{z}.p"
    e = f"({p} - 1)"
    e_form = (f"concat(substring({d}, 1, 1), "
              f"CASE WHEN length({d}) > 1 THEN concat('.', substring({d}, 2)) ELSE '' END, "
              f"'e', CASE WHEN {e} < 0 THEN '-' ELSE '+' END, "
              f"CASE WHEN abs({e}) < 10 THEN '0' ELSE '' END, CAST(abs({e}) AS STRING))")
    return (f"CASE WHEN {e} < -4 OR {e} >= 6 THEN {e_form} "
            f"WHEN {p} <= 0 THEN concat('0.', repeat('0', -{p}), {d}) "
            f"WHEN {p} >= length({d}) THEN concat({d}, repeat('0', {p} - length({d}))) "
            f"ELSE concat(substring({d}, 1, {p}), '.', substring({d}, {p} + 1)) END")


def go_float_sql(x: str) -> str:
    mant = "substring_index(gs, 'E', 1)"
    ip = f"substring_index({mant}, '.', 1)"
    fp = f"CASE WHEN instr({mant}, '.') > 0 THEN substring_index({mant}, '.', -1) ELSE '' END"
    e10 = "CASE WHEN instr(gs, 'E') > 0 THEN CAST(substring_index(gs, 'E', -1) AS INT) ELSE 0 END"
    # gw.raw = all digits, gw.ilen = integer-part length + exponent
    raw = f"named_struct('raw', concat({ip}, {fp}), 'ilen', length({ip}) + {e10})"
    digits = ("named_struct('d', regexp_replace(gn, '0+$', ''), "
              "'p', gw.ilen - (length(gw.raw) - length(gn)))")
    # JDK 17 may print 17 digits where fewer round-trip: for such texts take the
    # shortest %.Ne rendering that parses back to the same double.
    sig = ("length(regexp_replace(regexp_replace(substring_index(gj, 'E', 1), '[.]', ''), "
           "'^0+|0+$', ''))")
    shortest = ("upper(coalesce(get(filter(transform(sequence(1, 17), gp -> format_string("
                "concat('%.', CAST(gp - 1 AS STRING), 'e'), abs(gv))), "
                "gc -> CAST(gc AS DOUBLE) = abs(gv)), 0), gj))")
    text = let_sql("CAST(abs(gv) AS STRING)", "gj",
                   f"CASE WHEN {sig} >= 16 THEN {shortest} ELSE gj END")
    body = let_sql(text, "gs",
                   let_sql(raw, "gw",
                           let_sql("regexp_replace(gw.raw, '^0+', '')", "gn",
                                   let_sql(digits, "gz", _format_digits_sql("gz")))))
    return let_sql(f"CAST({x} AS DOUBLE)", "gv", (
        "CASE WHEN gv IS NULL THEN CAST(NULL AS STRING) "
        "WHEN isnan(gv) THEN 'NaN' "
        "WHEN gv = CAST('Infinity' AS DOUBLE) THEN '+Inf' "
        "WHEN gv = CAST('-Infinity' AS DOUBLE) THEN '-Inf' "
        "WHEN gv = 0 THEN CASE WHEN CAST(gv AS STRING) = '-0.0' THEN '-0' ELSE '0' END "
        f"ELSE concat(CASE WHEN gv < 0 THEN '-' ELSE '' END, {body}) END"))


def go_quote_sql(s: str) -> str:
    bs = "chr(92)"
    cases = ["WHEN qc = '' THEN ''",
             f"WHEN qc = {bs} THEN concat({bs}, {bs})",
             f"WHEN qc = chr(34) THEN concat({bs}, chr(34))"]
    cases += [f"WHEN ascii(qc) = {code} THEN concat({bs}, '{ch}')"
              for code, ch in GO_SHORT_ESCAPES.items()]
    cases.append(f"WHEN ascii(qc) < 32 OR ascii(qc) = 127 "
                 f"THEN format_string(concat({bs}, 'x%02x'), ascii(qc))")
    esc = "CASE " + " ".join(cases) + " ELSE qc END"
    return (f"concat(chr(34), array_join(transform(split(coalesce({s}, ''), ''), qc -> {esc}), ''), "
            f"chr(34))")


def go_float_text(x: str) -> Column:
    return F.expr(go_float_sql(x))


def go_quote(s: str) -> Column:
    return F.expr(go_quote_sql(s))
