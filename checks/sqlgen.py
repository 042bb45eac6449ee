"""Builders for the longer SQL texts: least squares by sweeping, scans by Gram-Schmidt, Student's t."""

from __future__ import annotations

from checks.registry import SQL_LONG


def p_value(t: str, df: str) -> str:
    """Two-sided Student t p-value for whole degrees of freedom, as a finite sum."""
    c2 = f"(({df})::DOUBLE / (({df})::DOUBLE + ({t}) * ({t})))"
    even = (
        f"1 - sqrt(1 - {c2}) * (1 + coalesce(list_sum(list_transform(range(1, (({df}) // 2)::BIGINT), "
        f"lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0) - 0.5 * ln(pi()) + j * ln({c2})))), 0))"
    )
    odd = (
        f"1 - 2 / pi() * (acos(least(1.0, sqrt({c2}))) + sqrt(1 - {c2}) * (CASE WHEN ({df}) > 1 THEN sqrt({c2}) ELSE 0 END + "
        f"coalesce(list_sum(list_transform(range(1, ((({df}) - 1) // 2)::BIGINT), "
        f"lambda j: exp(0.5 * ln(pi()) - ln(2) + lgamma(j + 1.0) - lgamma(j + 1.5) + (j + 0.5) * ln({c2})))), 0)))"
    )
    return f"(CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END)"


def ols(source: str, x: list[str], y: str, group: str | None = None) -> str:
    """CTEs ``src``, ``mom``, ``sw0..swk`` and ``coef(<g>, position, estimate, std_error, t_value, n, df, rss)``.

    Centred cross products are swept regressor by regressor, which leaves the inverse, the slopes
    and the residual sum of squares.
    """
    k = len(x)
    cols = [*x, y]
    g = f"{group} AS g, " if group else "0 AS g, "
    mean = ", ".join(f"avg({c}::DOUBLE) OVER (PARTITION BY g) AS m{i}" for i, c in enumerate(f"c{j}" for j in range(k + 1)))
    raw = ", ".join(f"({c})::DOUBLE AS c{i}" for i, c in enumerate(cols))
    prods = ", ".join(f"sum((c{i} - m{i}) * (c{j} - m{j})) AS a{i}_{j}" for i in range(k + 1) for j in range(k + 1))
    means = ", ".join(f"any_value(m{i}) AS m{i}" for i in range(k + 1))
    parts = [
        f"raw AS (SELECT {g}{raw} FROM ({source}))",
        f"src AS (SELECT *, {mean} FROM raw)",
        f"sw0 AS (SELECT g, count(*) AS n, {means}, {prods} FROM src GROUP BY g)",
    ]
    keep = "g, n, " + ", ".join(f"m{i}" for i in range(k + 1))
    for p in range(k):
        d = f"a{p}_{p}"
        new = []
        for i in range(k + 1):
            for j in range(k + 1):
                if i == p and j == p:
                    e = f"1 / {d}"
                elif i == p:
                    e = f"a{p}_{j} / {d}"
                elif j == p:
                    e = f"-a{i}_{p} / {d}"
                else:
                    e = f"a{i}_{j} - a{i}_{p} * a{p}_{j} / {d}"
                new.append(f"{e} AS a{i}_{j}")
        parts.append(f"sw{p + 1} AS (SELECT {keep}, {', '.join(new)} FROM sw{p})")
    rows = []
    df, rss = f"(n - {k + 1})", f"a{k}_{k}"
    for i in range(k):
        rows.append(f"SELECT g, {i + 1} AS position, a{i}_{k} AS estimate, sqrt({rss} / {df} * a{i}_{i}) AS std_error, n, {df} AS df, {rss} AS rss FROM sw{k}")
    b0 = f"m{k}" + "".join(f" - a{i}_{k} * m{i}" for i in range(k))
    quad = " + ".join(f"m{i} * a{i}_{j} * m{j}" for i in range(k) for j in range(k)) or "0"
    rows.append(f"SELECT g, {k + 1} AS position, {b0} AS estimate, sqrt({rss} / {df} * (1.0::DOUBLE / n + {quad})) AS std_error, n, {df} AS df, {rss} AS rss FROM sw{k}")
    parts.append(f"coef AS (SELECT *, estimate / std_error AS t_value FROM ({' UNION ALL '.join(rows)}))")
    return ",\n".join(parts)


def scans(y: str, steps: int, pairs: bool, tag: str = "") -> str:
    """CTEs of a forward search: ``x0`` (centred terms), ``b1..b<steps>`` (the best of each scan).

    After every scan all terms and the outcome lose their part along the chosen term.
    """
    t = tag
    single = "SELECT sample, term_id AS a, -1::BIGINT AS b, value FROM long"
    pair = "SELECT p.sample, p.term_id AS a, q.term_id AS b, p.value * q.value AS value FROM long p JOIN long q ON p.sample = q.sample AND p.term_id < q.term_id"
    terms = f"{single} UNION ALL {pair}" if pairs else single
    parts = []
    if not tag:
        parts += [
            f"long AS MATERIALIZED ({SQL_LONG})",
            f"terms AS MATERIALIZED (SELECT *, value - avg(value) OVER (PARTITION BY a, b) AS v FROM ({terms}))",
            "size0 AS MATERIALIZED (SELECT a, b, sum(v * v) AS ss FROM terms GROUP BY a, b)",
        ]
    parts += [
        f"{t}x0 AS (SELECT sample, a, b, v FROM terms)",
        f"{t}y0 AS (SELECT sample, y - avg(y) OVER () AS r FROM (SELECT vec_id AS sample, {y} AS y FROM embeddings))",
    ]
    for s in range(1, steps + 1):
        o = s - 1
        parts.append(
            f"{t}s{s} AS MATERIALIZED (SELECT a, b, count(*) - {s + 1} AS df, sum(v * v) AS xx, sum(v * r) AS xy, sum(r * r) AS yy "
            f"FROM {t}x{o} JOIN {t}y{o} USING (sample) GROUP BY a, b)"
        )
        parts.append(
            f"{t}b{s} AS MATERIALIZED (SELECT {s} AS iteration, a, b, df, xy / xx / sqrt((yy - xy * xy / xx) / df / xx) AS t "
            f"FROM {t}s{s} JOIN size0 USING (a, b) WHERE xx > 1e-10 * ss ORDER BY abs(t) DESC, b >= 0, a, b LIMIT 1)"
        )
        if s == steps:
            break
        parts.append(f"{t}q{s} AS MATERIALIZED (SELECT sample, v / sqrt(sum(v * v) OVER ()) AS q FROM {t}x{o} JOIN {t}b{s} USING (a, b))")
        parts.append(
            f"{t}x{s} AS MATERIALIZED (SELECT sample, a, b, v - q * sum(v * q) OVER (PARTITION BY a, b) AS v FROM {t}x{o} JOIN {t}q{s} USING (sample))"
        )
        parts.append(f"{t}y{s} AS MATERIALIZED (SELECT sample, r - q * sum(r * q) OVER () AS r FROM {t}y{o} JOIN {t}q{s} USING (sample))")
    return ",\n".join(parts)


def chosen_columns(y: str, k: int, tag: str = "") -> str:
    """``(sample, x1..xk, y)``: the raw columns of the first k chosen terms."""
    cols = ", ".join(f"x{i}" for i in range(1, k + 1))
    joins = " ".join(
        f"JOIN (SELECT sample, value AS x{i} FROM terms JOIN {tag}b{i} USING (a, b)) USING (sample)" for i in range(1, k + 1)
    )
    return f"SELECT sample, {cols}, y FROM (SELECT vec_id AS sample, {y} AS y FROM embeddings) {joins}"
