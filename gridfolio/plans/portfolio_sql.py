"""SQL views of one whole portfolio evaluation, written out per window and date."""

from __future__ import annotations

from gridfolio.plans.views_sql import view


def portfolio_views(
    t: str,
    *,
    score: str = "score_b",
    quantiles: int = 5,
    groups: tuple[int, ...] = (1, 2, 3, 4, 5),
    shorts: tuple[int, ...] = (1,),
    min_assets: int = 20,
    min_score: float | None = None,
    top_n: int = 0,
    bottom_n: int = 0,
    weighting: str = "equal",
    entry: str = "close",
    lag: int = 0,
    bps: tuple[float, float, float] = (0.0, 0.0, 0.0),
    dollar_neutral: bool = False,
    sector_neutral: bool = False,
    sector_unit: bool = False,
    sector_runs: bool = False,
    capital: float = 1_000_000.0,
    unit: str = "month",
    masked: bool = False,
) -> None:
    run = "sector" if sector_runs else "'all'"
    k = 1 - bps[0] / 10000
    charge = (bps[1] + bps[2]) / 10000
    cell = f"case when m.member > 0 then last_value({score} ignore nulls) over f end" if masked else f"last_value({score} ignore nulls) over f"
    capx = "case when m.member > 0 then last_value(c.cap ignore nulls) over f end" if masked else "last_value(c.cap ignore nulls) over f"
    openx = "case when m.member > 0 then last_value(g.open ignore nulls) over f end" if masked else "last_value(g.open ignore nulls) over f"
    mask = "join mask_w m on m.ticker = g.ticker and m.pos = g.pos" if masked else ""
    ever = "where m.ever" if masked else ""
    view(
        f"{t}_panel",
        f"""select g.ticker, g.pos, g.date, {openx} as open, g.close, {cell} as score, {capx} as cap
            from grid_w g join wide_scores s on s.ticker = g.ticker and s.pos = g.pos
            join mktcap_w c on c.ticker = g.ticker and c.pos = g.pos {mask} {ever}
            window f as (partition by g.ticker order by g.pos)""",
    )
    view(
        f"{t}_win",
        f"""
        with st as (select min(date) as d from wide_scores where {score} is not null),
        sch as (select max(date) as date from cal_w, st where date >= d group by date_trunc('{unit}', date)
                union select max(date) from cal_w),
        pr as (select date as signal_date, lead(date) over (order by date) as exit_date from sch)
        select row_number() over (order by p.signal_date) as wid, p.signal_date, e.date as entry_date, p.exit_date,
            e.pos as entry_pos, x.pos as exit_pos
        from pr p join cal_w c on c.date = p.signal_date join cal_w e on e.pos = c.pos + {lag}
        join cal_w x on x.date = p.exit_date where e.date < p.exit_date"""
        if score != "cap"
        else f"""
        with sch as (select max(date) as date from cal_w group by date_trunc('{unit}', date)
                union select max(date) from cal_w),
        pr as (select date as signal_date, lead(date) over (order by date) as exit_date from sch)
        select row_number() over (order by p.signal_date) as wid, p.signal_date, e.date as entry_date, p.exit_date,
            e.pos as entry_pos, x.pos as exit_pos
        from pr p join cal_w c on c.date = p.signal_date join cal_w e on e.pos = c.pos + {lag}
        join cal_w x on x.date = p.exit_date where e.date < p.exit_date""",
    )
    if sector_runs:
        how = f"join sector_cells s on s.ticker = p.ticker and s.pos = p.pos"
    else:
        how = """left join sector_w s on s.ticker = p.ticker
                 and s.date = (select max(q.date) from quarters_w q where q.date <= w.entry_date)"""
    view(
        f"{t}_cand",
        f"""select {run} as run, w.*, p.ticker, p.score, p.cap, p.{entry} as entry, x.close as exit, s.sector
            from {t}_win w join {t}_panel p on p.pos = w.entry_pos
            join {t}_panel x on x.ticker = p.ticker and x.pos = w.exit_pos {how}
            {"where s.sector is not null" if sector_runs else ""}""",
    )
    by = "run, wid, sector" if sector_neutral else "run, wid"
    low = f"and score >= {min_score}" if min_score is not None else ""
    extra = "and sector is not null" if sector_neutral else ""
    view(
        f"{t}_rank",
        f"""select *, row_number() over (partition by {by} order by score, ticker) as rk,
                count(*) over (partition by {by}) as n
            from {t}_cand where score is not null {low} {extra}""",
    )
    if top_n:
        placed = f"""select *, 'q1' as gid from {t}_rank where n >= {top_n + bottom_n} and n >= {min_assets} and rk <= {bottom_n}
            union all select *, 'q{quantiles}' from {t}_rank
            where n >= {top_n + bottom_n} and n >= {min_assets} and rk > n - {top_n}"""
    else:
        edges = " + ".join(
            ["1"] + [f"cast(rk::double / n::double > cast('{j * (1.0 / quantiles)!r}' as double) as integer)" for j in range(1, quantiles)]
        )
        ids = ", ".join(f"'q{g}'" for g in groups)
        placed = f"""select * from (select *, 'q' || ({edges}) as gid from {t}_rank
            where n >= {quantiles} and n >= {min_assets}) where gid in ({ids})"""
    view(f"{t}_mem", placed)
    view(
        f"{t}_prc",
        f"""select *, coalesce(entry > 0, false) and coalesce(x between 0.05 and 20.0, false) as kept,
                coalesce(entry > 0, false) and (coalesce(exit <= 0, true) or not coalesce(x between 0.05 and 20.0, false)) as halted
            from (select *, case when entry > 0 then xu / entry end as x
                  from (select *, case when coalesce(exit, 0) <= 0 then entry else exit end as xu from {t}_mem))""",
    )
    if sector_unit:
        part = "(partition by run, wid, gid, sector)"
        inner = "1.0"
        if weighting == "cap":
            inner = f"""case when count(case when cap is null then 1 end) over {part} = 0 and sum(greatest(cap, 0)) over {part} > 0
                then greatest(cap, 0) * count(*) over {part} / nullif(sum(greatest(cap, 0)) over {part}, 0) else 1.0 end"""
        base = f"{inner} / count(*) over {part}"
    elif weighting == "cap":
        base = "greatest(cap, 0)"
    else:
        base = "1.0"
    view(f"{t}_wgt", f"select *, {base} as base from {t}_prc")
    miss = "count(case when cap is null then 1 end)" if weighting == "cap" and not sector_unit else "0"
    view(
        f"{t}_tot",
        f"""select run, wid, gid, count(case when kept then 1 end) as g_kept, count(case when halted then 1 end) as g_halted,
            {miss} as g_missing, sum(base) as g_all, sum(case when kept then base end) as g_base
            from {t}_wgt group by run, wid, gid""",
    )
    view(
        f"{t}_pos",
        f"""select w.*, g_kept, g_halted, case when not kept then 0.0
            when g_missing = 0 and g_all > 0 and g_base > 0 then base / g_base else 1.0 / g_kept end as share
            from {t}_wgt w join {t}_tot t on t.run = w.run and t.wid = w.wid and t.gid = w.gid""",
    )
    short_ids = ", ".join(f"'q{s}'" for s in shorts) or "''"
    is_short = f"gid in ({short_ids})"
    view(
        f"{t}_raw",
        f"""select *, case when gross > 0 then gross * greatest(0, 1 - {charge!r} * least(greatest(frac, 0), 1)) else gross end as rawf
            from (select run, wid, gid, count(*) as n_pos, max(g_halted) as n_halted,
                    (max(g_kept) - max(g_halted)) / cast(max(g_kept) as double) as frac,
                    case when {is_short} then 1 + {k!r} * sum(share * (1 - x)) else {k!r} * sum(share * x) end as gross
                  from {t}_pos where share > 0 group by run, wid, gid)""",
    )
    view(
        f"{t}_days",
        f"""select w.wid, p.ticker, p.pos, last_value(p.close ignore nulls) over (partition by w.wid, p.ticker order by p.pos) as close
            from {t}_win w join {t}_panel p on p.pos between w.entry_pos and w.exit_pos""",
    )
    view(
        f"{t}_path",
        f"""select run, wid, gid, pos, case when max(cast(v <= 0 as integer)) over (partition by run, wid, gid order by pos) = 1
                then 0.0 else v end as v
            from (select m.run, m.wid, m.gid, m.pos,
                case when m.pos = max(m.pos) over g then r.rawf when m.pos = min(m.pos) over g then {k!r} else m.v end as v
                from (select p.run, p.wid, p.gid, d.pos,
                        case when {is_short} then {k!r} + {k!r} * sum(share * (1 - d.close / p.entry))
                             else {k!r} * sum(share * d.close / p.entry) end as v
                      from {t}_pos p join {t}_days d on d.wid = p.wid and d.ticker = p.ticker
                      where p.share > 0 and d.close is not null group by p.run, p.wid, p.gid, d.pos) m
                join {t}_raw r on r.run = m.run and r.wid = m.wid and r.gid = m.gid
                window g as (partition by m.run, m.wid, m.gid))""",
    )
    gl = ", ".join(f"'q{g}'" for g in groups)
    runs = f"(select distinct sector as run from sector_w)" if sector_runs else "(select 'all' as run)"
    view(
        f"{t}_f",
        f"""select u.run, w.*, g.gid, r.n_pos, r.n_halted, r.frac, r.gross,
                case when l.low <= 0 then 0.0 else coalesce(r.rawf, 1.0) end as f
            from {t}_win w cross join {runs} u cross join (select unnest([{gl}]) as gid) g
            left join {t}_raw r on r.run = u.run and r.wid = w.wid and r.gid = g.gid
            left join (select run, wid, gid, min(v) as low from {t}_path group by run, wid, gid) l
                on l.run = u.run and l.wid = w.wid and l.gid = g.gid""",
    )
    chain = "(partition by run, gid order by wid rows between unbounded preceding and 1 preceding)"
    if dollar_neutral:
        cap_in = f"{capital / 2!r} * coalesce(product(tot) over {chain}, 1)"
        src = f"(select *, avg(f) over (partition by run, wid) as tot from {t}_f)"
    else:
        cap_in = f"{capital!r} * coalesce(product(f) over {chain}, 1)"
        src = f"{t}_f"
    view(
        f"{t}_trd",
        f"""select *, case when cin <= 0 then cin else cin * f end as cout, case when cin <= 0 then 0.0 else f - 1 end as pr
            from (select *, {cap_in} as cin from {src})""",
    )
    view(
        f"{t}_eqg",
        f"""select q.run, q.gid, c.date, c.pos, q.eq from (
              select run, gid, pos, arg_max(eq, wid) as eq from (
                select t.run, t.gid, c.pos, t.wid, case when c.pos = t.exit_pos then t.cout
                    when t.n_pos is not null and t.cin > 0 then t.cin * p.v else t.cin end as eq
                from {t}_trd t join cal_w c on c.pos between t.entry_pos and t.exit_pos
                left join {t}_path p on p.run = t.run and p.wid = t.wid and p.gid = t.gid and p.pos = c.pos
                union all
                select t.run, t.gid, c.pos, 0, t.cin from {t}_trd t join cal_w c on c.date = t.signal_date where t.wid = 1)
              where eq is not null group by run, gid, pos) q join cal_w c on c.pos = q.pos""",
    )
    view(
        f"{t}_eq",
        f"""select * from {t}_eqg union all
            select run, 'net', date, pos, sum(eq) from (
                select d.run, g.gid, d.date, d.pos, last_value(e.eq ignore nulls) over (partition by d.run, g.gid order by d.pos) as eq
                from (select distinct run, date, pos from {t}_eqg) d
                join (select distinct run, gid from {t}_eqg) g on g.run = d.run
                left join {t}_eqg e on e.run = d.run and e.gid = g.gid and e.pos = d.pos)
            group by run, date, pos""",
    )
    view(
        f"{t}_tab",
        f"""select p.run, p.wid, p.gid, p.ticker, p.entry_date, p.exit_date, p.entry, p.xu, p.halted, p.score, p.sector,
                t.cin, t.cout, t.pr,
                case when p.{is_short} then -1 else 1 end * t.cin * {k!r} * p.share / p.entry as qty,
                t.cin * {k!r} * p.share as ev,
                case when p.{is_short} then t.cin * {k!r} * p.share * (2 - p.x) else t.cin * {k!r} * p.share * p.x end as xv
            from {t}_pos p join {t}_trd t on t.run = p.run and t.wid = p.wid and t.gid = p.gid
            where p.share > 0 and t.cin > 0""",
    )
