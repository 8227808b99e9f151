"""Exchange prices as a stream: each market's latest names are state, applied to its later messages."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "market string, pt long, selection long, name string, price double"


def named_prices(messages: DataFrame, order: str) -> DataFrame:
    """(market, pt, selection, name, price) of a stream of messages as ``files.exchange_messages`` yields them.

    A micro-batch's messages of a market go by time, then ``order``; names that an earlier
    micro-batch defined hold until they are defined anew. The state is one text for each market.
    """
    m = messages.filter("message.op = 'mcm'").select(F.col("message.pt").alias("pt"), F.col(order).alias("seq"), F.explode("message.mc").alias("mc"))
    names = F.when(F.col("mc.marketDefinition").isNotNull(), F.to_json(F.map_from_entries(F.transform("mc.marketDefinition.runners", lambda r: F.struct(r["id"].cast("string"), r["name"])))))
    best = lambda book: F.try_element_at(F.try_element_at(F.col(f"c.{book}"), F.lit(1)), F.lit(2))  # noqa: E731  level, price, size
    rows = m.select("pt", "seq", F.col("mc.id").alias("market"), names.alias("names"), F.explode_outer("mc.rc").alias("c"))
    rows = rows.select("market", "pt", "seq", "names", F.col("c.id").alias("selection"), F.coalesce("c.ltp", best("batb"), best("batl")).alias("price"))
    return rows.groupBy("market").applyInPandasWithState(_with_names, OUTPUT, "names string", "append", GroupStateTimeout.NoTimeout)


def _with_names(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(parts)).sort_values(["pt", "seq"], kind="stable")
    held = state.get[0] if state.exists else None
    names = rows["names"].astype(object).where(rows["names"].notna(), None).ffill()
    if held is not None:
        names = names.where(names.notna(), held)
    latest = names.iloc[-1]
    if latest is not None and latest == latest:
        state.update((latest,))
    known: dict[str, dict] = {}
    of = lambda text, i: known.setdefault(text, json.loads(text)).get(str(int(i))) if isinstance(text, str) else None
    out = rows.assign(names=names)[rows["price"].notna() & rows["selection"].notna()]
    yield pd.DataFrame({"market": out["market"], "pt": out["pt"].astype("int64"), "selection": out["selection"].astype("int64"), "name": [of(t, i) for t, i in zip(out["names"], out["selection"], strict=True)], "price": out["price"].astype("float64")})
