"""Registered queries: sources, sinks, cleaning, filters, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfolio.functions.expr import rounded
from gridfolio.operators import cleaning as cl
from gridfolio.operators.panels import in_years
from gridfolio.operators.ranking import ordered_rank
from gridfolio.plans.registry import query
from gridfolio.plans.views_sql import r, view
from gridfolio.sources import panels, tables
from gridfolio.sources.store import new_path

C = F.col
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


# ------------------------------------------------------------------ derived raw inputs

view(
    "wide_regions",
    "select w.date as d, "
    + ", ".join(f"avg(case when r_name = '{x}' then close end) as \"{x}\"" for x in REGIONS)
    + """ from bars_m w join supplier on cast(s_suppkey as varchar) = ticker join nation on n_nationkey = s_nationkey
        join region on r_regionkey = n_regionkey group by 1""",
)


def wide_regions(spark, sf, date_name: str):
    """Monthly mean close per region as a wide panel."""
    home = tables.table(spark, sf, "supplier").join(tables.table(spark, sf, "nation"), C("s_nationkey") == C("n_nationkey"))
    home = home.join(tables.table(spark, sf, "region"), C("n_regionkey") == C("r_regionkey"))
    home = home.select(C("s_suppkey").cast("string").alias("ticker"), "r_name")
    bars = tables.bars(spark, sf, "M").select("ticker", "date", "close").join(home, "ticker")
    return bars.groupBy(C("date").alias(date_name)).pivot("r_name", REGIONS).agg(F.avg("close"))


LONG_SQL = " union all ".join(f"select d as date, '{x}' as ticker, {r(f'\"{x}\"')} as value from wide_regions" for x in REGIONS)


@query("src1_wide_panel", LONG_SQL)
def src1(spark, sf):
    path = new_path(spark, "wide")
    wide_regions(spark, sf, "Date").write.parquet(path)
    return panels.read_wide_panel(spark, path).select("date", "ticker", rounded(C("value")).alias("value"))


@query("src2_index_column", LONG_SQL)
def src2(spark, sf):
    wide = wide_regions(spark, sf, "__index_level_0__")
    wide = wide.withColumn("__index_level_0__", C("__index_level_0__").cast("timestamp"))
    return panels.to_long(wide).select("date", "ticker", rounded(C("value")).alias("value"))


view(
    "sheet_m",
    """
    select 7 as row_no, cast(ticker as bigint) * 5 + i as col_no, ticker as cell
    from (select distinct ticker from bars_m), (select unnest([1, 2, 3, 4, 5]) as i)
    union all
    select 13, cast(ticker as bigint) * 5 + i, ' ' || case i when 1 then '수정시가' when 2 then '수정고가' when 3 then '수정저가'
        when 4 then '수정주가' else '거래량' end
    from (select distinct ticker from bars_m), (select unnest([1, 2, 3, 4, 5]) as i)
    union all
    select pos + 13, 0, case when pos % 11 = 0 then 'total' else cast(date as varchar) end from cal_m
    union all
    select c.pos + 13, cast(b.ticker as bigint) * 5 + i,
        case when cast(b.ticker as bigint) % 17 = 3 and i = 4 and c.pos % 5 = 0 then '#INVALID OPTION'
             else cast(cast(round(case i when 1 then open when 2 then high when 3 then low when 4 then close else volume end * 100)
                  as bigint) as varchar) end
    from bars_m b join cal_m c on c.date = b.date, (select unnest([1, 2, 3, 4, 5]) as i)""",
)
ITEMS = ["수정시가", "수정고가", "수정저가", "수정주가", "거래량"]


def vendor_sheet(spark, sf):
    """A vendor sheet as (row_no, col_no, cell): five columns per supplier."""
    bars = tables.bars(spark, sf, "M")
    cal = tables.bar_calendar(spark, sf, "M")
    col = C("ticker").cast("long") * 5 + C("i")
    fields = F.posexplode(F.array(*[F.lit(x) for x in ITEMS]))
    names = tables.table(spark, sf, "lineitem").select(C("l_suppkey").cast("string").alias("ticker")).distinct()
    heads = names.select("ticker", fields).select("ticker", (C("pos") + 1).alias("i"), "col")
    tickers = heads.select(F.lit(7).alias("row_no"), col.alias("col_no"), C("ticker").alias("cell"))
    items = heads.select(F.lit(13).alias("row_no"), col.alias("col_no"), F.concat(F.lit(" "), "col").alias("cell"))
    dates = cal.select(
        (C("pos") + 13).alias("row_no"),
        F.lit(0).cast("long").alias("col_no"),
        F.when(C("pos") % 11 == 0, F.lit("total")).otherwise(C("date").cast("string")).alias("cell"),
    )
    placed = bars.join(F.broadcast(cal), "date").select(
        "ticker", C("pos").alias("p"), F.posexplode(F.array("open", "high", "low", "close", "volume"))
    ).select("ticker", "p", (C("pos") + 1).alias("i"), C("col").alias("v"))
    bad = (C("ticker").cast("long") % 17 == 3) & (C("i") == 4) & (C("p") % 5 == 0)
    body = placed.select(
        (C("p") + 13).alias("row_no"),
        col.alias("col_no"),
        F.when(bad, F.lit("#INVALID OPTION")).otherwise(F.round(C("v") * 100).cast("long").cast("string")).alias("cell"),
    )
    return tickers.unionByName(items).unionByName(dates).unionByName(body)


SHEET_BARS = """
    select d.date, h.ticker, max(case when i.f = 'open' then try_cast(s.cell as double) end) as open,
        max(case when i.f = 'high' then try_cast(s.cell as double) end) as high,
        max(case when i.f = 'low' then try_cast(s.cell as double) end) as low,
        max(case when i.f = 'close' then try_cast(s.cell as double) end) as close,
        max(case when i.f = 'volume' then try_cast(s.cell as double) end) as volume
    from sheet_m s
    join (select row_no, try_cast(cell as date) as date from sheet_m where col_no = 0 and row_no >= 14) d
        on d.row_no = s.row_no and d.date is not null
    join (select col_no, cell as ticker from sheet_m where row_no = 7) h on h.col_no = s.col_no
    join (select col_no, case trim(cell) when '수정시가' then 'open' when '수정고가' then 'high' when '수정저가' then 'low'
            when '수정주가' then 'close' else 'volume' end as f from sheet_m where row_no = 13) i on i.col_no = s.col_no
    where s.row_no >= 14 and s.col_no > 0 {where} group by 1, 2"""
BAD_TICKERS = """select distinct h.cell from sheet_m s join sheet_m h on h.row_no = 7 and h.col_no = s.col_no
    join sheet_m d on d.col_no = 0 and d.row_no = s.row_no and try_cast(d.cell as date) is not null
    where s.row_no >= 14 and s.cell like '%#INVALID OPTION%'"""


@query("src3_vendor_sheet_bars", SHEET_BARS.format(where=f"and h.ticker not in ({BAD_TICKERS})"))
def src3(spark, sf):
    return cl.vendor_bars(vendor_sheet(spark, sf))


@query("cln3_invalid_tickers", f"select cell as ticker from ({BAD_TICKERS})")
def cln3(spark, sf):
    return cl.invalid_tickers(cl.sheet_cells(vendor_sheet(spark, sf)))


@query("cln11_item_projection", SHEET_BARS.format(where=""))
def cln11(spark, sf):
    return cl.project_items(cl.sheet_cells(vendor_sheet(spark, sf)))


view(
    "cells_w",
    """
    select c.pos + 13 as row_no, case when b.volume % 13 = 0 then 'n/a' else cast(b.date as varchar) end as date,
        'T' || b.ticker as ticker,
        case when cast(b.ticker as bigint) % 17 = 3 and c.pos % 9 = 0 then 'x #INVALID OPTION'
             when b.volume % 7 = 0 then 'missing'
             else cast(cast(round(b.close * 100) as bigint) as varchar) end as value
    from bars_w b join cal_w c on c.date = b.date""",
)


def raw_cells(spark, sf):
    """A vendor metric sheet in long form: date and value as text."""
    bars = tables.bars(spark, sf).select("ticker", "date", "close", "volume")
    cal = tables.bar_calendar(spark, sf)
    joined = bars.join(F.broadcast(cal), "date")
    bad = (C("ticker").cast("long") % 17 == 3) & (C("pos") % 9 == 0)
    return joined.select(
        (C("pos") + 13).alias("row_no"),
        F.when(C("volume") % 13 == 0, F.lit("n/a")).otherwise(C("date").cast("string")).alias("date"),
        F.concat(F.lit("T"), "ticker").alias("ticker"),
        F.when(bad, F.lit("x #INVALID OPTION"))
        .when(C("volume") % 7 == 0, F.lit("missing"))
        .otherwise(F.round(C("close") * 100).cast("long").cast("string"))
        .alias("value"),
    )


MARKED = "ticker in (select ticker from cells_w where row_no >= 20 and value like '%#INVALID OPTION%')"


@query(
    "src4_metric_sheet",
    f"""select try_cast(date as date) as date, ticker, case when {MARKED} then 0.0 else try_cast(value as double) end as value
        from cells_w where row_no >= 20 and try_cast(date as date) is not null
        and ticker in (select ticker from cells_w where row_no >= 20 and try_cast(date as date) is not null
            and (try_cast(value as double) is not null or {MARKED}))""",
)
def src4(spark, sf):
    steps = [cl.skip_rows(20), cl.zero_marked_tickers(), cl.coerce_dates, cl.coerce_numbers, cl.drop_empty_tickers]
    path = new_path(spark, "metric")
    cl.chain(raw_cells(spark, sf), steps).select("date", "ticker", "value").write.parquet(path)
    return spark.read.parquet(path)


@query("cln1_skip_rows", "select row_no, date, ticker, value from cells_w where row_no >= 20")
def cln1(spark, sf):
    return raw_cells(spark, sf).transform(cl.skip_rows(20))


@query(
    "cln2_invalid_marker",
    """select row_no, date, ticker, case when ticker in (select ticker from cells_w where value like '%#INVALID OPTION%')
        then '0' else value end as value from cells_w""",
)
def cln2(spark, sf):
    return raw_cells(spark, sf).transform(cl.zero_marked_tickers())


@query("cln4_date_coercion", "select row_no, try_cast(date as date) as date, ticker, value from cells_w where try_cast(date as date) is not null")
def cln4(spark, sf):
    return raw_cells(spark, sf).transform(cl.coerce_dates)


@query(
    "cln5_drop_empty_tickers",
    """select row_no, ticker, v as value from (select *, count(v) over (partition by ticker) as n from (
        select *, case when cast(substr(ticker, 2) as bigint) % 5 > 0 then try_cast(value as double) end as v from cells_w)) where n > 0""",
)
def cln5(spark, sf):
    cells = raw_cells(spark, sf).transform(cl.coerce_numbers)
    holed = cells.withColumn("value", F.when(F.substring("ticker", 2, 20).cast("long") % 5 > 0, C("value")))
    return holed.transform(cl.drop_empty_tickers).select("row_no", "ticker", "value")


@query("cln6_lower_names", "select row_no, lower(ticker) as ticker, value from cells_w")
def cln6(spark, sf):
    return raw_cells(spark, sf).transform(cl.lower_names).select("row_no", "ticker", "value")


@query("cln7_numeric_coercion", "select row_no, ticker, try_cast(value as double) as value from cells_w")
def cln7(spark, sf):
    return raw_cells(spark, sf).transform(cl.coerce_numbers).select("row_no", "ticker", "value")


@query(
    "cln8_status_recode",
    """select l_orderkey, l_suppkey, l_partkey, l_linenumber, case when v = '정상' then '1' when v = '거래정지' then '0' else v end as value
       from (select *, trim(case when l_returnflag = 'N' then ' 정상' when l_returnflag = 'R' then '거래정지 ' else ' other ' end) as v
             from lineitem)""",
)
def cln8(spark, sf):
    rows = tables.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_returnflag")
    label = F.when(C("l_returnflag") == "N", F.lit(" 정상")).when(C("l_returnflag") == "R", F.lit("거래정지 ")).otherwise(F.lit(" other "))
    return rows.withColumn("value", label).drop("l_returnflag").transform(cl.status_flags())


SECTOR_CASE = " ".join(f"when {i} then '{k}'" for i, k in enumerate(cl.SECTOR_LABELS))
SECTOR_ENGLISH = " ".join(f"when v = '{k}' then '{v}'" for k, v in cl.SECTOR_LABELS.items())


@query(
    "cln9_sector_recode",
    f"""select s_suppkey, case {SECTOR_ENGLISH} else v end as value
        from (select s_suppkey, trim(' ' || case s_suppkey % 12 {SECTOR_CASE} else 'other' end || ' ') as v from supplier)""",
)
def cln9(spark, sf):
    names = F.array(*[F.lit(k) for k in cl.SECTOR_LABELS])
    label = F.coalesce(F.get(names, (C("s_suppkey") % 12).cast("int")), F.lit("other"))
    rows = tables.table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit(" "), label, F.lit(" ")).alias("value"))
    return rows.transform(cl.sector_names())


@query(
    "cln10_panel_normalisation",
    """select date, ticker, value from (
         select cast(ts as date) as date, cast(user_id as varchar) as ticker, case when day(ts) % 6 > 0 then value end as value,
            row_number() over (partition by cast(ts as date), user_id order by event_id) as rn,
            count(case when day(ts) % 6 > 0 then value end) over (partition by cast(ts as date)) as n from events)
       where rn = 1 and n > 0""",
)
def cln10(spark, sf):
    raw = tables.table(spark, sf, "events").select(
        F.to_date("ts").alias("date"),
        C("user_id").cast("string").alias("ticker"),
        "event_id",
        F.when(F.dayofmonth(F.to_date("ts")) % 6 > 0, C("value")).alias("value"),
    )
    return cl.normalise_panel(raw, "event_id")


NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("src5_named_datasets", " union all ".join(f"select '{n}' as name, count(*) as n_rows from {n}" for n in NAMES))
def src5(spark, sf):
    data = panels.Datasets(spark, sf)
    names = sorted(row["name"] for row in data.available().collect())  # file names of one folder
    out = None
    for name in names:
        part = data.load(name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("src6_latest_date", "select strftime(max(date), '%Y%m%d') as latest from bars_w")
def src6(spark, sf):
    return cl.largest_date(tables.bars(spark, sf).select("date"))


@query("src7_excluded_tickers", "select date, ticker, close from bars_w where ticker not in (select ticker from bars_w where volume > 200)")
def src7(spark, sf):
    bars = tables.bars(spark, sf).select("date", "ticker", "close", "volume")
    path = new_path(spark, "excluded")
    panels.write_tickers(bars.where(C("volume") > 200).select("ticker").distinct(), path)
    return bars.drop("volume").join(panels.read_tickers(spark, path), "ticker", "left_anti")


@query("snk1_score_panels", f"select model, ticker, date, {r('score')} as score from scores_long where model <> 'b'")
def snk1(spark, sf):
    path = new_path(spark, "scores")
    panels.save_partitioned(tables.scores(spark, sf, ["a", "b", "c"]), path, ["model"])
    back = spark.read.schema("ticker string, date date, score double, model string").parquet(path)
    return back.where(C("model") != "b").select("model", "ticker", "date", rounded(C("score")).alias("score"))


RESULT_SQL = f"select model, ticker, date, label, prediction, {r('prob_up')} as prob_up from results_long"


@query("snk2_result_tables", RESULT_SQL)
def snk2(spark, sf):
    path = new_path(spark, "results")
    tables.results(spark, sf, ["a", "b", "c"]).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select("model", "ticker", "date", "label", "prediction", rounded(C("prob_up")).alias("prob_up"))


DAYS = "date between date '1996-03-01' and date '1997-02-28'"


@query("flt1_date_range", f"select ticker, date, close from bars_w where {DAYS} and ticker in ('1', '2', '3', '5', '8')")
def flt1(spark, sf):
    return tables.bars(spark, sf, days=("1996-03-01", "1997-02-28"), tickers=(1, 2, 3, 5, 8)).select("ticker", "date", "close")


@query("flt2_year_filter", "select ticker, date, close from bars_w where year(date) in (1996, 1998)")
def flt2(spark, sf):
    """The scan takes the span of the years; the years themselves are picked after it."""
    bars = tables.bars(spark, sf, days=("1996-01-01", "1998-12-31"))
    return in_years(bars.select("ticker", "date", "close"), (1996, 1998))


@query(
    "flt3_benchmark_symbol",
    f"select ticker, date, {r('score')} as score from scores_long where model = 'b' and ticker in (select ticker from bars_m where date >= '1999-01-01') and ticker <> '7'",
)
def flt3(spark, sf):
    prices = tables.bars(spark, sf, "M").where(C("date") >= "1999-01-01")
    kept = cl.without_symbol(tables.scores(spark, sf, ["b"]), prices, "7")
    return kept.select("ticker", "date", rounded(C("score")).alias("score"))


@query("flt4_minimum_score", f"select ticker, date, {r('score')} as score from scores_long where model = 'b' and score >= 0.25")
def flt4(spark, sf):
    kept = tables.scores(spark, sf, ["b"]).where(C("score") >= 0.25)
    return kept.select("ticker", "date", rounded(C("score")).alias("score"))


@query(
    "flt5_field_consistency",
    """select date, count(*) as n_cells, count(case when (open is null) or (high is null) or (low is null) or (close is null)
        or (volume is null) then 1 end) as n_holes, count(case when high < low or open > high or close > high or open < low or close < low then 1 end)
        as n_crossed from bars_w group by date""",
)
def flt5(spark, sf):
    bars = tables.bars(spark, sf).select("date", *tables.OHLCV)
    hole = F.greatest(*[C(f).isNull().cast("int") for f in tables.OHLCV]) == 1
    crossed = (C("high") < F.greatest("low", "open", "close")) | (C("low") > F.least("open", "close"))
    return bars.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count(F.when(hole, 1)).alias("n_holes"), F.count(F.when(crossed, 1)).alias("n_crossed")
    )


@query(
    "flt6_time_split",
    """select b.ticker, b.date, case when c.pos <= floor(0.7::double * c.n_dates) then 'train' else 'valid' end as part_ratio,
        case when year(b.date) in (1995, 1996) then 'train' else 'valid' end as part_years from bars_w b join cal_w c on c.date = b.date""",
)
def flt6(spark, sf):
    bars = tables.bars(spark, sf).select("ticker", "date")
    by_ratio = cl.first_share_by_date(bars, tables.bar_calendar(spark, sf), 0.7).withColumnRenamed("part", "part_ratio")
    return cl.split_by_year(by_ratio, (1995, 1996)).withColumnRenamed("part", "part_years")


@query(
    "flt7_stratified_split",
    """select ticker, date, label, case when row_number() over (partition by label order by md5(ticker || '|' || cast(date as varchar) || '|42'))
        <= floor(0.8::double * count(*) over (partition by label)) then 'train' else 'valid' end as part from results_long where model = 'a'""",
)
def flt7(spark, sf):
    rows = tables.results(spark, sf, ["a"]).select("ticker", "date", "label")
    return cl.split_stratified(rows, "label", ["ticker", "date"], 0.8)


@query(
    "flt8_row_order_split",
    """select ticker, date, label, case when row_number() over (order by date, ticker) <= floor(0.8::double * count(*) over ())
        then 'train' else 'valid' end as part from results_long where model = 'a'""",
)
def flt8(spark, sf):
    return cl.split_by_row_order(tables.results(spark, sf, ["a"]).select("ticker", "date", "label"), 0.8)


@query(
    "top1_top_bottom_per_date",
    f"""select date, ticker, {r('score')} as score, side, n from (
        select *, 'bottom' as side, row_number() over (partition by date order by score, ticker) as n from scores_long where model = 'b'
        union all select *, 'top', row_number() over (partition by date order by score desc, ticker desc) from scores_long where model = 'b')
        where n <= 5""",
)
def top1(spark, sf):
    out = cl.top_and_bottom(tables.scores(spark, sf, ["b"]), "score", 5, 5)
    return out.select("date", "ticker", rounded(C("score")).alias("score"), "side", "n")


@query(
    "wn17_first_occurrence_rank",
    "select date, ticker, row_number() over (partition by date order by score, ticker) as rank, count(*) over (partition by date) as n from scores_long where model = 'b'",
)
def wn17(spark, sf):
    return ordered_rank(tables.scores(spark, sf, ["b"]).select("date", "ticker", "score"), ["date"], "score").select("date", "ticker", "rank", "n")
