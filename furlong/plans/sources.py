"""Queries of unknown tables, names and typed cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.operators import cells, mapping, quality, views
from furlong.plans.imports import _RAW_SQL, _raw_card
from furlong.plans.registry import RUNNERS_SQL, query, tidy
from furlong.sources import racing

_CARD = {"runner_id": ("null", "unmapped"), "race_id": ("'race_id'", "high"), "race_date": ("'race_date'", "high"), "racecourse": ("'course'", "medium"), "horse_name": ("'horse_name'", "high"), "weight_lbs_total": ("'weight'", "medium"), "non_runner": ("'non_runner'", "high"), "flat_jumps": ("'flat_jumps'", "high")}


def _profile_sql(c: str) -> str:
    first = f"select string_agg(v, '|' order by runner_id) from (select runner_id, left({c}::varchar, 60) as v from raw where {c} is not null order by runner_id limit 3)"
    return f"select '{c}' as column_name, count(*) as rows, round(100.0::double * count({c}) / count(*), 1) as present_pct, ({first}) as samples, {_CARD[c][0]} as role, '{_CARD[c][1]}' as confidence from raw"


@query(f"with {_RAW_SQL} " + " union all ".join(map(_profile_sql, _CARD)))
def mapping_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the columns of a race card hold, and the roles that their names suggest."""
    out = mapping.profile(_raw_card(spark, sf_dir).select(*_CARD), "runner_id")
    return out.withColumn("samples", F.array_join("samples", "|"))


@query(f"""with {_RAW_SQL} select 'race_date' as date_column, min(try_cast(race_date as date))::varchar as first_day, max(try_cast(race_date as date))::varchar as last_day from raw where race_date like '____-%'""")
def card_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A race card's date column, its first and last day."""
    out = mapping.date_range(_raw_card(spark, sf_dir))
    return out.select("date_column", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"))


@query(f"with {_RAW_SQL} select race_id::varchar as race_id, race_date, horse_name, racecourse as course, weight_lbs_total as weight from raw where racecourse is not null")
def mapped_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A race card under the names of a mapping: what needs no confirmation, and two columns that someone confirmed."""
    rows = _raw_card(spark, sf_dir)
    agreed = mapping.reviewed(mapping.confident(rows.columns), rows.columns, {"racecourse": "course", "weight_lbs_total": "weight", "non_runner": None, "flat_jumps": None})
    return mapping.mapped(rows.filter("racecourse is not null"), agreed).select("race_id", "race_date", "horse_name", "course", "weight")


_NAMES_SQL = """n as (select 'JOCKEY' as entity_type, case when c_custkey % 3 = 0 then upper(c_name) || '.' else c_name end as raw_name, c_custkey % 2 = 0 as held from customer
  union all select 'TRAINER', case when s_suppkey % 3 = 0 then '  ' || s_name else s_name end, s_suppkey % 2 = 0 from supplier union all select 'COURSE', n_name, false from nation union all select 'COURSE', lower(n_name), true from nation)"""


@query(f"""with {_NAMES_SQL} select entity_type, raw_name, trim(regexp_replace(regexp_replace(lower(raw_name), '[''`.,]', '', 'g'), '\\s+', ' ', 'g')) as canonical_id, not bool_or(held) as created from n group by 1, 2, 3""")
def free_text_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling of jockeys, trainers and courses with its normalized name, and whether that spelling is new."""
    t = lambda name: racing.table(spark, sf_dir, name)
    one = lambda df, kind, raw, held: df.select(F.lit(kind).alias("entity_type"), raw.alias("raw_name"), held.alias("held"))
    names = one(t("customer"), "JOCKEY", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.upper("c_name"), F.lit("."))).otherwise(F.col("c_name")), F.col("c_custkey") % 2 == 0)
    names = names.union(one(t("supplier"), "TRAINER", F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("  "), "s_name")).otherwise(F.col("s_name")), F.col("s_suppkey") % 2 == 0))
    names = names.union(one(t("nation"), "COURSE", F.col("n_name"), F.lit(False))).union(one(t("nation"), "COURSE", F.lower("n_name"), F.lit(True)))
    return quality.aliases(names.drop("held"), names.filter("held").drop("held"))


@query("""with v as (select event_id, event_type as key, ['NUMERIC', 'TEXT', 'BOOLEAN', 'CATEGORY', 'NUMERIC'][event_id % 5 + 1] as kind, case event_id % 5 when 0 then event_id::varchar when 2 then case when event_id % 2 = 0 then 'true' else 'false' end when 4 then 'much' else 'v' || event_id end as text from events),
e as (select *, case event_type_of when null then null else event_type_of end as expected from (select *, map {'click': 'NUMERIC', 'view': 'TEXT', 'purchase': 'BOOLEAN', 'signup': 'CATEGORY'}[key] as event_type_of from v)),
j as (select *, case when expected is null then 'unknown key ' || key when kind <> expected then key || ' expects ' || expected || ', got ' || kind when event_id % 5 = 4 then key || ' holds no NUMERIC' end as error from e)
select event_id, case when error is null and kind = 'NUMERIC' then text::double end as numeric_value, case when error is null and kind in ('TEXT', 'CATEGORY') then text end as text_value, case when error is null and kind = 'BOOLEAN' then text = 'true' end as boolean_value, error from j""")
def feature_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values put into the column of their type, or refused with a reason."""
    i = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("NUMERIC", "TEXT", "BOOLEAN", "CATEGORY", "NUMERIC")]), (i % 5 + 1).cast("int"))
    text = F.when(i % 5 == 0, i.cast("string")).when(i % 5 == 2, F.when(i % 2 == 0, "true").otherwise("false")).when(i % 5 == 4, "much").otherwise(F.concat(F.lit("v"), "event_id"))
    rows = racing.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("key"), kind.alias("kind"), text.alias("text"))
    out = cells.typed_cells(rows, {"click": "NUMERIC", "view": "TEXT", "purchase": "BOOLEAN", "signup": "CATEGORY"})
    return out.select("event_id", "numeric_value", "text_value", "boolean_value", "error")


@query(f"""with {RUNNERS_SQL}, k as (select *, row_number() over (partition by horse_id order by race_ts desc, race_id desc, runner_id desc) as n from runners)
select horse_id, count(*) as runs, count(*) filter (finishing_position = 1) as wins, count(*) filter (finishing_position <= 3) as places, count(distinct course) as courses, strftime(min(race_ts), '%Y-%m-%d') as first_day, strftime(max(race_ts), '%Y-%m-%d') as last_day,
  string_agg(race_id || ':' || coalesce(finishing_position::varchar, '-'), ' ' order by n) filter (n <= 5) as latest from k group by 1""")
def horse_explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each horse: its record, when and where it ran, and its latest five runs."""
    out = views.horse_pages(racing.runners(spark, sf_dir))
    return tidy(out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_day", "last_day")}))
