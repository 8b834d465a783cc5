"""Landed JSON responses (one document per row) to typed rows.

Each function takes a frame with the text column ``payload`` (for instance
``spark.read.text(path).withColumnRenamed("value", "payload")``) and keeps the other
columns it is told to.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.scalar import UNIT_MS, floor_to
from barline.operators.bars import CONTRACT_FACE_VALUE, FIVE_MIN_MS, side_buckets
from barline.operators.series import HOUR_MS
from barline.session import materialize

ZERO_ADDRESS = "0x0000000000000000000000000000000000000000"


def _json(schema: str) -> Column:
    return F.from_json(F.col("payload"), schema)


def _num(c: Column) -> Column:
    return c.try_cast("double")


def _int(c: Column) -> Column:
    return c.try_cast("bigint")


def candle_arrays(df: DataFrame, keep: Sequence[str] = (), is_futures: Column | None = None, tf: str = "1m") -> DataFrame:
    """[ts, o, h, l, c, vol, volCcy, volCcyQuote, confirm] arrays; closed bars only.

    For futures the volume is the base-currency column, for spot the plain one.
    """
    fut = is_futures if is_futures is not None else F.lit(False)
    k = F.col("_k")
    return (
        df.select(*keep, fut.alias("_fut"), F.explode(_json("data array<array<string>>")["data"]).alias("_k"))
        .filter(F.get(k, F.lit(8)) == "1")
        .select(
            *keep,
            F.lit(tf).alias("tf"),
            _int(F.get(k, F.lit(0))).alias("ts"),
            *[_num(F.get(k, F.lit(i))).alias(n) for i, n in enumerate(("open", "high", "low", "close"), start=1)],
            _num(F.when(F.col("_fut"), F.get(k, F.lit(6))).otherwise(F.get(k, F.lit(5)))).alias("volume"),
            _num(F.when(F.col("_fut"), F.get(k, F.lit(7))).otherwise(F.get(k, F.lit(6)))).alias("quote_volume"),
            F.lit(None).cast("double").alias("taker_buy_volume"),
            F.lit(None).cast("bigint").alias("trades"),
        )
    )


def funding_snapshot(df: DataFrame, observed_at: str, keep: Sequence[str] = ()) -> DataFrame:
    """First entry of a funding response, dated by its observation.

    The settlement time lies in the future and is kept as context only.
    """
    e = F.get(_json("data array<struct<instId:string,fundingRate:string,fundingTime:string>>")["data"], F.lit(0))
    return (
        df.withColumn("_e", e)
        .filter(F.col("_e").isNotNull())
        .select(
            *keep,
            F.col(observed_at).alias("ts"),
            _num(F.col("_e.fundingRate")).alias("rate"),
            _int(F.col("_e.fundingTime")).alias("next_funding_time"),
        )
    )


def open_interest_snapshot(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """First entry of an open-interest response, in base currency."""
    e = F.get(_json("data array<struct<instId:string,oi:string,oiCcy:string,ts:string>>")["data"], F.lit(0))
    return (
        df.withColumn("_e", e)
        .filter(F.col("_e").isNotNull())
        .select(*keep, _int(F.col("_e.ts")).alias("ts"), _num(F.col("_e.oiCcy")).alias("oi_base"))
    )


def ratio_fractions(ratio: Column) -> tuple[Column, Column]:
    """Long and short share of a long/short ratio."""
    return ratio / (1.0 + ratio), 1.0 / (1.0 + ratio)


def ratio_snapshot(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """First [ts, ratio] entry as ratio and both fractions."""
    e = F.get(_json("data array<array<string>>")["data"], F.lit(0))
    r = _num(F.get(F.col("_e"), F.lit(1)))
    long_, short = ratio_fractions(r)
    return (
        df.withColumn("_e", e)
        .filter(F.col("_e").isNotNull())
        .select(
            *keep,
            F.lit("all_account").alias("ratio_type"),
            _int(F.get(F.col("_e"), F.lit(0))).alias("ts"),
            long_.alias("long_ratio"),
            short.alias("short_ratio"),
            r.alias("ls_ratio"),
        )
    )


def _need(values: Column, message: str) -> Column:
    """The array, or a job failure when it is missing or empty."""
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, values).otherwise(
        F.raise_error(F.lit(message))
    )


@dataclass(frozen=True)
class Parsed:
    """Rows of the good documents, and the others with the reason why they gave none."""

    rows: DataFrame
    rejects: DataFrame


def _split(df: DataFrame, points: Column, shape: Callable[[DataFrame], DataFrame], keep: Sequence[str], nothing: str) -> Parsed:
    """Good documents as rows, bad ones as (keep, payload, reason); documents are parsed once for both."""
    parsed = materialize(df.select(*keep, "payload", points.alias("_points")), "parsed")
    usable = F.exists("_points", lambda p: p.isNotNull())
    reason = (
        F.when(F.col("payload").isNull(), "no document")
        .when(F.get_json_object("payload", "$").isNull(), "not JSON")
        .when(F.col("_points").isNull() | ~F.coalesce(usable, F.lit(False)), nothing)
    )
    judged = parsed.withColumn("reason", reason)
    good, bad = judged.filter("reason IS NULL"), judged.filter("reason IS NOT NULL")
    return Parsed(shape(good).filter("ts IS NOT NULL"), bad.select(*keep, "payload", "reason"))


def _volatility_rows(keep: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    p = F.col("_p")
    return lambda df: df.select(*keep, F.explode("_points").alias("_p")).select(
        *keep, floor_to(F.get(p, F.lit(0)).cast("bigint"), HOUR_MS).alias("ts"), F.get(p, F.lit(4)).alias("dvol")
    )


def _sentiment_rows(keep: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn("_e", F.get("_points", F.lit(0))).select(
        *keep,
        (_int(F.col("_e.timestamp")) * 1000).alias("ts"),
        _num(F.col("_e.value")).alias("value"),
        F.col("_e.value_classification").alias("classification"),
    )


_VOLATILITY = "result struct<data:array<array<double>>>"
_SENTIMENT = "data array<struct<value:string,value_classification:string,timestamp:string>>"


def volatility_points(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Volatility index points, floored to the hour, close only; a document without points fails the job."""
    data = _need(_json(_VOLATILITY)["result"]["data"], "no volatility points")
    return _volatility_rows(keep)(df.select(*keep, data.alias("_points")))


def volatility_points_or_rejects(df: DataFrame, keep: Sequence[str] = ()) -> Parsed:
    """``volatility_points`` of the good documents; one bad document costs no other its points."""
    return _split(df, _json(_VOLATILITY)["result"]["data"], _volatility_rows(keep), keep, "no volatility points")


def sentiment_point(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """First sentiment point, seconds to ms; a document without one fails the job."""
    data = _need(_json(_SENTIMENT)["data"], "no sentiment points")
    return _sentiment_rows(keep)(df.select(*keep, data.alias("_points")))


def sentiment_point_or_rejects(df: DataFrame, keep: Sequence[str] = ()) -> Parsed:
    """``sentiment_point`` of the good documents; one bad document costs no other its point."""
    return _split(df, _json(_SENTIMENT)["data"], _sentiment_rows(keep), keep, "no sentiment points")


def daily_bar_arrays(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Daily bars from parallel timestamp/open/close arrays, without padded bars."""
    doc = _json(
        "chart struct<result:array<struct<timestamp:array<bigint>,"
        "indicators:struct<quote:array<struct<open:array<double>,close:array<double>>>>>>>"
    )
    res = F.get(doc["chart"]["result"], F.lit(0))
    quote = F.get(res["indicators"]["quote"], F.lit(0))
    zipped = F.arrays_zip(
        res["timestamp"].alias("ts"), quote["open"].alias("open"), quote["close"].alias("close")
    )
    return (
        df.select(*keep, F.explode(zipped).alias("_b"))
        .filter(F.col("_b.open").isNotNull() & F.col("_b.close").isNotNull() & F.col("_b.ts").isNotNull())
        .select(*keep, (F.col("_b.ts") * 1000).alias("ts"), F.col("_b.open").alias("open"), F.col("_b.close").alias("close"))
    )


def token_mints(df: DataFrame, keep: Sequence[str] = (), source: str = "etherscan") -> DataFrame:
    """Transfers from the zero address as mint events; a status other than '1' gives none."""
    doc = _json(
        "status string, result array<struct<`from`:string,value:string,tokenDecimal:string,timeStamp:string,hash:string>>"
    )
    t = F.col("_t")
    return (
        df.withColumn("_doc", doc)
        .filter(F.col("_doc.status") == "1")
        .select(*keep, F.explode("_doc.result").alias("_t"))
        .filter(F.lower(t["from"]) == ZERO_ADDRESS)
        .select(
            *keep,
            F.lit("usdt_mint").alias("event_type"),
            (_int(t["timeStamp"]) * 1000).alias("ts"),
            (_num(t["value"]) / F.pow(F.lit(10.0), _num(t["tokenDecimal"]))).alias("magnitude"),
            F.to_json(F.struct(t["hash"].alias("tx_hash"))).alias("payload"),
            F.lit(source).alias("source_id"),
            F.concat(F.lit("usdt_mint:"), t["hash"]).alias("dedupe_key"),
        )
    )


def liquidation_fills(df: DataFrame, inst_id: str, keep: Sequence[str] = ()) -> DataFrame:
    """Fills with position side and notional; an unknown contract gives no rows.

    ``inst_id`` names the column with the contract; groups without details are skipped.
    """
    faces = None
    for contract, face in CONTRACT_FACE_VALUE.items():
        hit = F.col(inst_id) == contract
        faces = F.when(hit, F.lit(face)) if faces is None else faces.when(hit, F.lit(face))
    doc = _json("data array<struct<details:array<struct<bkPx:string,sz:string,posSide:string,ts:string>>>>")
    d = F.col("_d")
    return (
        df.withColumn("_face", faces)
        .filter(F.col("_face").isNotNull())
        .select(*keep, "_face", F.explode(doc["data"]).alias("_g"))
        .select(*keep, "_face", F.explode("_g.details").alias("_d"))
        .select(
            *keep,
            _int(d["ts"]).alias("ts"),
            d["posSide"].alias("pos_side"),
            (_num(d["sz"]) * F.col("_face") * _num(d["bkPx"])).alias("notional"),
        )
    )


def liquidation_buckets(df: DataFrame, inst_id: str, keys: Sequence[str]) -> DataFrame:
    """5-minute buckets of the fills per position side."""
    fills = liquidation_fills(df, inst_id, keys)
    return side_buckets(fills, keys, F.col("pos_side"), F.col("notional"), "long", "short", FIVE_MIN_MS)


def gap_events(bars: DataFrame, prev_close: Column, prev_ts: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Opening gaps over at least two days from bars with their predecessor."""
    days = F.round((F.col("ts") - prev_ts) / F.lit(float(UNIT_MS["d"]))).cast("bigint")
    pct = F.try_divide(F.col("open") - prev_close, prev_close) * 100
    date = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd")
    return (
        bars.withColumns({"gap_days": days, "magnitude_pct": pct})
        .filter(F.col("gap_days") >= 2)
        .select(
            *keep,
            F.lit("cme_gap").alias("event_type"),
            "ts",
            F.abs("magnitude_pct").alias("magnitude"),
            "magnitude_pct",
            "gap_days",
            F.concat(F.lit("cme_gap:"), date).alias("dedupe_key"),
        )
    )
