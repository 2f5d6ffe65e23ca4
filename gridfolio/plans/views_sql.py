"""Named SQL views that the cross-check queries build on."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}


def view(name: str, text: str) -> None:
    if name in VIEWS:
        raise ValueError(f"view {name} is defined twice")
    VIEWS[name] = text


def with_views(body: str) -> str:
    """Prefix a query with the views it names, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body
    heads = ",\n".join(f"{n} as ({VIEWS[n]})" for n in ordered)
    body = body.strip()
    if body.lower().startswith("with recursive"):
        return f"with recursive {heads},\n{body[len('with recursive'):]}"
    if body.lower().startswith("with "):
        return f"with {heads},\n{body[len('with '):]}"
    return f"with {heads}\n{body}"


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def sig(expr: str) -> str:
    """Nine significant digits, for values of very different size."""
    return f"(cast(printf('%.8e', cast({expr} as double)) as double) + 0.0)"


def _bars(unit: str) -> str:
    return f"""
    select ticker, date,
           max(case when up = 1 then price end) as open, max(price) as high, min(price) as low,
           max(case when dn = 1 then price end) as close,
           sum(l_quantity) as volume, sum(l_extendedprice) as amount,
           sum(l_discount * l_extendedprice) as flow
    from (select *,
             row_number() over (partition by ticker, date order by cast(l_shipdate as date), l_orderkey, l_linenumber,
                 l_extendedprice, l_quantity) as up,
             row_number() over (partition by ticker, date order by cast(l_shipdate as date) desc, l_orderkey desc,
                 l_linenumber desc, l_extendedprice desc, l_quantity desc) as dn
          from (select *, cast(l_suppkey as varchar) as ticker,
                       cast(date_trunc('{unit}', l_shipdate) as date) as date,
                       l_extendedprice / nullif(l_quantity, 0) as price
                from lineitem))
    group by ticker, date"""


view("bars_w", _bars("week"))
view("bars_m", _bars("month"))
view(
    "bars_d",
    """
    select ticker, date, max(case when up = 1 then value end) as open, max(value) as high, min(value) as low,
           max(case when dn = 1 then value end) as close, cast(count(*) as double) as volume
    from (select cast(user_id as varchar) as ticker, cast(ts as date) as date, value,
             row_number() over (partition by user_id, cast(ts as date) order by event_id) as up,
             row_number() over (partition by user_id, cast(ts as date) order by event_id desc) as dn
          from events)
    group by ticker, date""",
)
for _f in "wmd":
    view(
        f"cal_{_f}",
        f"""select date, cast(row_number() over (order by date) as integer) as pos,
                   cast(count(*) over () as integer) as n_dates
            from (select distinct date from bars_{_f})""",
    )
    view(
        f"grid_{_f}",
        f"""select t.ticker, c.pos, c.date, b.* exclude (ticker, date)
            from (select distinct ticker from bars_{_f}) t cross join cal_{_f} c
            left join bars_{_f} b on b.ticker = t.ticker and b.date = c.date""",
    )
view(
    "quarters_w",
    """select date, row_number() over (order by date) as q
       from (select min(date) as date from cal_w group by date_trunc('quarter', date))""",
)
view(
    "sector_w",
    """
    select q.date, cast(s.s_suppkey as varchar) as ticker, r.r_name as sector
    from supplier s join nation n on n.n_nationkey = s.s_nationkey cross join quarters_w q
    join region r on r.r_regionkey = case when s.s_suppkey % 10 = 0 and q.q % 7 = 0
        then (n.n_regionkey + 1) % 5 else n.n_regionkey end""",
)
view(
    "mktcap_w",
    """select ticker, pos, date,
        sum(amount) over (partition by ticker order by pos rows between 51 preceding and current row) as cap
       from grid_w""",
)
view(
    "universe_w",
    """
    select date, ticker, case when row_number() over (partition by date order by cap, ticker) * 5
        > count(*) over (partition by date) then 1.0 else 0.0 end as member
    from mktcap_w where cap is not null and date in (select date from quarters_w)""",
)
view("benchmark_w", "select date, 'ALL' as symbol, avg(close) as value from bars_w group by date")
view(
    "wide_scores",
    """
    select ticker, pos, date, close,
        close / nullif(lag(close, 1) over t, 0) - 1 as score_a,
        close / nullif(lag(close, 4) over t, 0) - 1 as score_b,
        close / nullif(lag(close, 13) over t, 0) - 1 as score_c,
        lead(close) over t / nullif(close, 0) - 1 as ret
    from grid_w window t as (partition by ticker order by pos)""",
)
view(
    "scores_long",
    """
    select 'a' as model, ticker, pos, date, score_a as score from wide_scores where score_a is not null
    union all select 'b', ticker, pos, date, score_b from wide_scores where score_b is not null
    union all select 'c', ticker, pos, date, score_c from wide_scores where score_c is not null""",
)
view(
    "results_long",
    """
    select s.model, s.ticker, s.date, cast(w.ret > 0 as integer) as label,
        cast(1 / (1 + exp(-s.score)) > 0.5 as integer) as prediction,
        1 - 1 / (1 + exp(-s.score)) as prob_down, 1 / (1 + exp(-s.score)) as prob_up
    from scores_long s join wide_scores w on w.ticker = s.ticker and w.date = s.date
    where w.ret is not null""",
)

view(
    "mask_w",
    """select ticker, pos, coalesce(last_value(member ignore nulls) over (partition by ticker order by pos), 0) as member,
        coalesce(max(member) over (partition by ticker), 0) > 0 as ever
       from (select g.ticker, g.pos, u.member from grid_w g left join universe_w u on u.ticker = g.ticker and u.date = g.date)""",
)
