"""Exchange / bus message normalisers.

Input: a DataFrame of raw messages ``(source STRING, raw STRING, ingest_time
TIMESTAMP)`` — a Kafka or file stream in production, a batch DataFrame in
tests.  Each message is parsed ONCE: an object into the few fields that any
feed has, all as text, an array (Kraken's) into its items.  A feed only names
its fields; numbers and times are converted after that, in one projection for
all feeds, with ``try_`` functions: a malformed one never fails the job, its
row goes to :func:`invalid_messages`, out of the same parse.  Every normaliser
is a stateless projection + filter, so the same code runs on batch and
streaming DataFrames, and the mixed-feed router is one scan of the stream, no
union.  Every trade of a message becomes a row with an id that is the same
whenever the message is read again.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import instant_to_ntz, ntz_from_micros

# Defaults filled into a trade, and labels of the tick feeds.
DEFAULT_SIDE = "unknown"
DEFAULT_EXCHANGE = "coinbase"
DEFAULT_PAIR = "BTC-USD"
ENVELOPE_SOURCE = "nex_stream"
TICK_SOURCE_LABELS = {"nex_stream": "NEX Stream"}
TICK_SOURCE_DEFAULT = "Coinbase"
TICK_SUBJECT_DEFAULT = "ticker"
TRADE_FEEDS = ("coinbase", "binance", "kraken", "plain")
TICK_FEEDS = ("bus", "coinbase_ticker")
# The last millisecond of year 9999; trade ids of a numbered message start at its number times this.
MAX_EPOCH_MILLIS = 253_402_300_799_999
IDS_PER_MESSAGE = 1 << 20


# The fields that feeds read of an object, as text whatever their JSON type; `_bad` is the message where it is no object.
_FIELDS = ("type", "price", "size", "side", "e", "T", "p", "q", "m", "exchange", "pair", "timestamp", "subject", "data", "source", "time")
_OBJECT = ",".join(f"`{f}` string" for f in (*_FIELDS, "_bad"))
_STRICT = {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _num(c: Column) -> Column:
    """A finite double, else NULL ("NaN" and "Infinity" are no prices; NaN is above infinity)."""
    n = c.try_cast("double")
    return F.when(F.abs(n) < float("inf"), n)


def _parse_once(df: DataFrame, *keep: str) -> DataFrame:
    """`v`: the fields of a message that is an object, `items`: the texts of one that is an array.

    Catalyst would substitute a projected parse into every filter that reads it,
    parsing again for each; producing it through a generator (`inline` of a
    one-element array) makes real columns that later filters cannot be pushed below.
    """
    raw = F.col("raw")
    array = raw.rlike(r"^\s*\[")
    parsed = F.struct(F.when(~array, F.from_json(raw, _OBJECT, _STRICT)).alias("v"),
                      F.when(array, F.from_json(raw, "array<string>", _STRICT)).alias("items"))
    return df.select(*keep, F.inline(F.array(parsed)))


def _not_json() -> Column:
    """Neither object nor array, and no other JSON value (looked at only then)."""
    none = F.col("items").isNull() & (F.col("v").isNull() | _f("_bad").isNotNull())
    return none & F.try_parse_json("raw").isNull()


def _f(field: str) -> Column:
    return F.col("v").getField(field)


def _arrival() -> Column:
    """Arrival instant as UTC wall time (independent of the session zone)."""
    return instant_to_ntz(F.col("ingest_time"))


def _millis_ntz(ms: Column) -> Column:
    """Wall time of epoch milliseconds; NULL unless a whole number up to year 9999."""
    n = ms.try_cast("long")
    return ntz_from_micros(F.when(F.abs(n) <= MAX_EPOCH_MILLIS, n * F.lit(1000)))


# -------------------------------------------------------------- per feed
# Each feed turns a message into an array of entries, texts still: one for each
# trade or tick of the message, none for other traffic.

_ENTRY = "array<struct<price:string,size:string,side:string,time:string>>"


def _entry(price: Column, size: Column | None = None, side: Column | None = None, time: Column | None = None) -> Column:
    parts = zip(("price", "size", "side", "time"), (price, size, side, time))
    return F.struct(*[(F.lit(None) if c is None else c).cast("string").alias(n) for n, c in parts])


def _if(is_entry: Column, entries: Column) -> Column:
    return F.when(F.coalesce(is_entry, F.lit(False)), entries).otherwise(F.lit(None).cast(_ENTRY))


def _coinbase() -> Column:
    return _if(_f("type") == "match", F.array(_entry(_f("price"), _f("size"), _f("side"))))


def _binance() -> Column:
    side = F.when(F.lower(_f("m")) == "true", F.lit("sell")).otherwise(F.lit("buy"))
    return _if(_f("e") == "trade", F.array(_entry(_f("p"), _f("q"), side, _f("T"))))


def _kraken() -> Column:
    def trade(item: Column) -> Column:
        side = F.when(F.get(item, F.lit(3)) == "b", F.lit("buy")).otherwise(F.lit("sell"))
        return _entry(F.get(item, F.lit(0)), F.get(item, F.lit(1)), side)

    trades = F.from_json(F.get("items", F.lit(1)), "array<array<string>>", _STRICT)
    return _if(F.get("items", F.lit(2)) == "trade", F.transform(trades, trade))


def _plain() -> Column:
    return _if(_f("price").isNotNull(), F.array(_entry(_f("price"), _f("size"), _f("side"), _f("timestamp"))))


def _envelope() -> Column:
    # an absent price is 0.0; one that is there and no number is a reject
    price = F.coalesce(F.get_json_object(_f("data"), "$.price"), F.lit("0"))
    return _if(_f("subject").isNotNull() & _f("data").isNotNull(), F.array(_entry(price, time=_f("timestamp"))))


def _ticker() -> Column:
    return _if((_f("type") == "ticker") | _f("source").isNotNull(), F.array(_entry(_f("price"), time=_f("time"))))


_FEEDS = {"coinbase": _coinbase, "binance": _binance, "kraken": _kraken, "plain": _plain,
          "bus": _envelope, "coinbase_ticker": _ticker}
TRADE_COLS = ("id", "timestamp", "price", "size", "side", "exchange", "pair")


def _entry_id(columns: Sequence[str]) -> Column:
    """A trade's id, the same whenever its message is read again: from the message's number
    (`msg_id`), or its place in the log (`topic`, `partition`, `offset`), or else a hash of its
    source, text and arrival; and the trade's position in the message."""
    pos = F.col("pos").cast("long")
    source = [c for c in ("source",) if c in columns]
    if "msg_id" in columns:
        return F.coalesce(F.try_add(F.try_multiply(F.col("msg_id").cast("long"), F.lit(IDS_PER_MESSAGE)), pos),
                          F.xxhash64(*source, "raw", "ingest_time", pos))
    if {"topic", "partition", "offset"} <= set(columns):
        return F.xxhash64("topic", "partition", "offset", pos)
    return F.xxhash64(*source, "raw", "ingest_time", pos)


def parse_messages(raw: DataFrame, feed: str | None = None, source_col: str = "source") -> DataFrame:
    """One row for each trade or tick of each message, good or not, and for each message that is
    none of a known feed's: all columns of `raw`, `kind` (trade, tick or NULL), `pos` (place in the
    message), `id`, the entry's columns, and `reason` (NULL: good; else not_json, unknown_feed,
    bad_number or bad_time).  With `feed` every message is read as that feed's.

    One projection over one scan, batch or stream: trades and rejects come out of the same parse.
    """
    parsed = _parse_once(raw, "*")
    src = F.lit(feed) if feed is not None else F.col(source_col)
    if feed is not None:
        entries = _FEEDS[feed]()
    else:
        entries = F.array(_entry(F.lit(None)))  # of an unknown feed
        for name, fn in _FEEDS.items():
            entries = F.when(src == name, fn()).otherwise(entries)
    message = F.when(_not_json(), F.lit("not_json"))
    if feed is None:
        message = message.when(~src.isin(*_FEEDS) | src.isNull(), F.lit("unknown_feed"))
    kind = F.when(src.isin(*TRADE_FEEDS), F.lit("trade")).when(src.isin(*TICK_FEEDS), F.lit("tick"))
    subject = F.when(src == "bus", _f("subject")).when(src == "coinbase_ticker", F.coalesce(_f("subject"), F.lit(TICK_SUBJECT_DEFAULT)))
    label = F.when(_f("source") == "nex_stream", F.lit(TICK_SOURCE_LABELS["nex_stream"])).otherwise(F.lit(TICK_SOURCE_DEFAULT))
    flat = src == "plain"
    marked = parsed.select(
        "*", message.alias("_message"), kind.alias("kind"), subject.alias("subject"),
        F.when(src == "bus", F.lit(ENVELOPE_SOURCE)).when(src == "coinbase_ticker", label).alias("tick_source"),
        F.when(flat, F.coalesce(_f("exchange"), F.lit(DEFAULT_EXCHANGE))).when(src.isin(*TRADE_FEEDS), src).alias("exchange"),
        F.when(flat, F.coalesce(_f("pair"), F.lit(DEFAULT_PAIR))).when(src.isin(*TRADE_FEEDS), F.lit(DEFAULT_PAIR)).alias("pair"))
    entries = F.when(F.col("_message").isNotNull(), F.array(_entry(F.lit(None)))).otherwise(entries)
    rows = marked.select(*raw.columns, "_message", "kind", "subject", "tick_source", "exchange", "pair", F.posexplode(entries).alias("pos", "x"))
    # texts to numbers and times, once for all feeds
    sent = F.col("x.time")
    millis = F.when(src.isin("binance", "plain", "bus"), _millis_ntz(sent))
    iso = F.when(src == "coinbase_ticker", instant_to_ntz(F.try_to_timestamp(sent)))
    arrived = F.when(src.isin("coinbase", "kraken", "bus"), _arrival())
    read = rows.select(*raw.columns, "_message", "kind", "pos", _entry_id(raw.columns).alias("id"),
                       F.coalesce(millis, iso).alias("_sent"), arrived.alias("_arrived"), sent.alias("_time"),
                       _num(F.col("x.price")).alias("price"), _num(F.col("x.size")).alias("size"), F.col("x.side").alias("side"),
                       "exchange", "pair", "tick_source", "subject")
    bad_time = F.col("_sent").isNull() & ((src == "coinbase_ticker") | F.col("_time").isNotNull())
    reason = (F.when(F.col("_message").isNotNull(), F.col("_message"))
              .when(F.col("price").isNull() | (F.col("size").isNull() & (F.col("kind") == "trade")), F.lit("bad_number"))
              .when(bad_time, F.lit("bad_time")))
    return read.select(*raw.columns, "kind", "pos", "id", F.coalesce("_sent", "_arrived").alias("timestamp"), "price", "size", "side",
                       "exchange", "pair", "tick_source", "subject", reason.alias("reason"))


def good_trades(rows: DataFrame) -> DataFrame:
    """The trades among what :func:`parse_messages` gives, with all columns."""
    return rows.filter(F.col("reason").isNull() & (F.col("kind") == "trade"))


def _trades(rows: DataFrame) -> DataFrame:
    return good_trades(rows).select(*TRADE_COLS)


def _ticks(rows: DataFrame) -> DataFrame:
    good = rows.filter(F.col("reason").isNull() & (F.col("kind") == "tick"))
    return good.select("id", "price", F.col("timestamp").alias("time"), F.col("tick_source").alias("source"), "subject")


def norm_coinbase(raw: DataFrame) -> DataFrame:
    """`type == 'match'` -> trade; timestamp = arrival time."""
    return _trades(parse_messages(raw, "coinbase"))


def norm_binance(raw: DataFrame) -> DataFrame:
    """`e == 'trade'` -> trade at T (ms); side sell when `m` (maker) else buy."""
    return _trades(parse_messages(raw, "binance"))


def norm_kraken(raw: DataFrame) -> DataFrame:
    """S3: `[chan, [[price, vol, time, side, ...], ...], 'trade', pair]` -> every
    trade of the array; 'b' = buy."""
    return _trades(parse_messages(raw, "kraken"))


def norm_plain(raw: DataFrame) -> DataFrame:
    """Flat trade JSON from the bus (price, size, side, exchange, pair, ms)."""
    return _trades(parse_messages(raw, "plain"))


def normalize_trades(raw: DataFrame, source_col: str = "source") -> DataFrame:
    """Every trade of every trade feed's messages (the union U1 of the feeds),
    with an id that later operators order by."""
    return _trades(parse_messages(raw, source_col=source_col))


def invalid_messages(raw: DataFrame, source_col: str = "source") -> DataFrame:
    """Side output of all six feeds: (source, raw, pos, reason) of each entry
    that no relation takes (see :func:`parse_messages`)."""
    rows = parse_messages(raw, source_col=source_col)
    return rows.filter(F.col("reason").isNotNull()).select(source_col, "raw", "pos", "reason")


def split_messages(raw: DataFrame, trades_path: str, rejects_path: str, mode: str = "append") -> None:
    """Write the trades and the rejects of a batch (or a stream's micro-batch, in
    `foreachBatch`) from one parse, which is kept while both are written."""
    rows = parse_messages(raw).persist()
    try:
        _trades(rows).write.mode(mode).parquet(trades_path)
        rows.filter(F.col("reason").isNotNull()).select("source", "raw", "pos", "reason").write.mode(mode).parquet(rejects_path)
    finally:
        rows.unpersist()


def norm_envelope(raw: DataFrame) -> DataFrame:
    """Bus envelope `{subject, data: {price}, timestamp?}` -> tick with
    price = data.price (0.0 when absent), time = timestamp (ms) or arrival,
    source 'nex_stream'."""
    return _ticks(parse_messages(raw, "bus"))


def norm_ticker(raw: DataFrame) -> DataFrame:
    """Accept `type == 'ticker'` or any message with a `source`: price, ISO
    `time`, source label ('nex_stream' -> 'NEX Stream', else 'Coinbase'),
    subject (default 'ticker')."""
    return _ticks(parse_messages(raw, "coinbase_ticker"))


def normalize_ticks(raw: DataFrame, subjects: Sequence[str] | None = None, source_col: str = "source") -> DataFrame:
    """S4 + S5 over one scan of mixed bus traffic; with `subjects` only those."""
    rows = parse_messages(raw, source_col=source_col)
    return _ticks(rows if subjects is None else subject_filter(rows, subjects))


def subject_filter(messages: DataFrame, subscriptions: Sequence[str], subject_col: str = "subject") -> DataFrame:
    """Keep messages whose subject is subscribed; '*' subscribes to all."""
    subs = list(subscriptions)
    if "*" in subs:
        return messages
    return messages.filter(F.col(subject_col).isin(*subs))


def default_fill(trades: DataFrame) -> DataFrame:
    """Numbers to double (malformed -> NULL); side 'unknown', exchange
    'coinbase', pair 'BTC-USD' when missing or empty."""
    def dflt(c: str, v: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v))
    out = trades.withColumn("price", F.col("price").cast("string").try_cast("double")) \
                .withColumn("size", F.col("size").cast("string").try_cast("double"))
    return out.withColumn("side", dflt("side", DEFAULT_SIDE)) \
              .withColumn("exchange", dflt("exchange", DEFAULT_EXCHANGE)) \
              .withColumn("pair", dflt("pair", DEFAULT_PAIR))


def subscribed_messages(messages: DataFrame, subscribers: DataFrame, subject_col: str = "subject") -> DataFrame:
    """S8 with a subscriber table `(client_id, subject)`: messages that at least
    one client wants.  '*' wants them all: it is one more value that a message
    may match, so batch and stream take the same plan and Spark picks the join."""
    wanted = subscribers.select(F.col(subject_col).alias("_wanted")).filter(F.col("_wanted").isNotNull()).distinct()
    star = wanted.filter(F.col("_wanted") == "*").agg(F.count(F.lit(1)).alias("_star"))  # one row
    own = messages.join(F.broadcast(star))
    key = F.when(F.col("_star") > 0, F.lit("*")).otherwise(F.col(subject_col))
    return own.withColumn("_key", key).join(wanted, F.col("_key") == F.col("_wanted"), "left_semi").drop("_key", "_star")
