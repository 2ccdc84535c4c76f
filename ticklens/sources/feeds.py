"""Stand-in raw message feeds built from the `events` table.

This only *writes* messages in each feed's wire format — one message per
event, with the feed chosen by user_id, non-trade chatter for 'view' events
and a few malformed messages for 'error' events.  All parsing, routing,
filtering and defaulting is done by :mod:`ticklens.sources.messages`.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import epoch_micros_ntz, ntz_to_instant

# Feed per user_id % 4.
FEED_BY_MOD = {0: "coinbase", 1: "binance", 2: "kraken", 3: "plain"}


def _s(c: Column) -> Column:
    return c.cast("string")


def raw_messages_from_events(events: DataFrame, feed: str | None = None, kraken_trades: int = 1) -> DataFrame:
    """One raw message per event; Kraken's hold `kraken_trades` trades, each a unit dearer.  With `feed`, every event is written in that
    feed's format; otherwise the feed is chosen per user (mixed traffic)."""
    k = F.get_json_object("props", "$.k").cast("long")
    size = (k.cast("double") + F.lit(1.0)) / F.lit(100.0)
    buy = F.col("event_type").isin("purchase", "signup")
    side = F.when(buy, F.lit("buy")).otherwise(F.lit("sell"))
    # malformed prices and, where the feed sends times, one that no timestamp holds
    error, kind = F.col("event_type") == "error", k % 25
    price_txt = (F.when(error & (kind == 0), F.lit("abc")).when(error & (kind == 2), F.lit("NaN"))
                  .when(error & (kind == 3), F.lit("Infinity")).otherwise(_s(F.col("value"))))
    ms = F.floor(epoch_micros_ntz("ts") / F.lit(1000))
    sent_ms = F.when(error & (kind == 4), F.lit(9_223_372_036_854_775_807)).otherwise(ms)
    seconds = F.concat(_s(F.floor(ms / 1000)), F.lit("."), F.lpad(_s(ms % 1000), 3, "0"))
    feed_mod = F.col("user_id") % 4
    if feed is None:
        feed = F.when(feed_mod == 0, "coinbase").when(feed_mod == 1, "binance") \
                .when(feed_mod == 2, "kraken").otherwise("plain")
    else:
        if feed not in FEED_BY_MOD.values():
            raise ValueError(f"unknown feed: {feed}")
        feed = F.lit(feed)
    coinbase = F.to_json(F.struct(F.lit("match").alias("type"), price_txt.alias("price"),
                                  _s(size).alias("size"), side.alias("side")))
    binance = F.to_json(F.struct(F.lit("trade").alias("e"), sent_ms.alias("T"), price_txt.alias("p"),
                                 _s(size).alias("q"), (~buy).alias("m")))
    def item(price: Column) -> Column:
        return F.to_json(F.array(price, _s(size), seconds, F.when(buy, F.lit("b")).otherwise(F.lit("s")), F.lit("l"), F.lit("")))

    trade_items = F.concat_ws(",", *[item(price_txt if j == 0 else _s(F.col("value") + j)) for j in range(kraken_trades)])
    kraken = F.concat(F.lit("["), _s(F.col("user_id")), F.lit(",["), trade_items, F.lit('],"trade","XBT/USD"]'))
    plain_price = F.when(price_txt.isin("abc", "NaN", "Infinity"), F.concat(F.lit('"'), price_txt, F.lit('"'))).otherwise(_s(F.col("value")))
    plain = F.concat(F.lit('{"price":'), plain_price, F.lit(',"size":'), _s(size), F.lit(',"side":"'), side,
                     F.lit('","exchange":"nex","pair":"BTC-USD","timestamp":'), _s(sent_ms), F.lit("}"))
    chatter = (F.when(feed == "coinbase", F.lit('{"type":"subscriptions"}'))
                .when(feed == "binance", F.lit('{"result":null,"id":1}'))
                .when(feed == "kraken", F.lit('{"event":"heartbeat"}'))
                .otherwise(F.lit('{"status":"ok"}')))
    trade_msg = (F.when(feed == "coinbase", coinbase).when(feed == "binance", binance)
                  .when(feed == "kraken", kraken).otherwise(plain))
    raw = (F.when(F.col("event_type") == "view", chatter)
            .when((F.col("event_type") == "error") & (k % 25 == 1), F.lit("not json"))
            .otherwise(trade_msg))
    return events.select(F.col("event_id").alias("msg_id"), feed.alias("source"), raw.alias("raw"),
                         ntz_to_instant("ts").alias("ingest_time"))


def bus_messages_from_events(events: DataFrame, source: str | None = None) -> DataFrame:
    """Bus traffic: envelopes `{subject, data: {price}, timestamp}` (source 'bus') for even user_ids
    and Coinbase ticker messages ('coinbase_ticker') for odd ones, or with `source` that for all."""
    ms = F.floor(epoch_micros_ntz("ts") / F.lit(1000))
    even = F.col("user_id") % 2 == 0 if source is None else F.lit(source == "bus")
    envelope = F.to_json(F.struct(F.lit("market.btc-usd.trades").alias("subject"),
                                  F.struct(F.col("value").alias("price")).alias("data"), ms.alias("timestamp")))
    ticker = F.to_json(F.struct(F.lit("ticker").alias("type"), F.col("value").cast("string").alias("price"),
                                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time")))
    return events.select(F.col("event_id").alias("msg_id"),
                         F.when(even, F.lit("bus")).otherwise(F.lit("coinbase_ticker")).alias("source"),
                         F.when(even, envelope).otherwise(ticker).alias("raw"),
                         ntz_to_instant("ts").alias("ingest_time"))
