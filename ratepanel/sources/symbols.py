"""Readable labels for market symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The symbol universe and its labels.
LABELS = {
    "EURUSD=X": "EUR_USD",
    "GBPUSD=X": "GBP_USD",
    "USDJPY=X": "USD_JPY",
    "AUDUSD=X": "AUD_USD",
    "USDCAD=X": "USD_CAD",
    "USDCHF=X": "USD_CHF",
    "NZDUSD=X": "NZD_USD",
    "USDINR=X": "USD_INR",
    "USDCNY=X": "USD_CNY",
    "USDSGD=X": "USD_SGD",
    "USDHKD=X": "USD_HKD",
    "USDKRW=X": "USD_KRW",
    "USDBRL=X": "USD_BRL",
    "USDMXN=X": "USD_MXN",
    "USDTRY=X": "USD_TRY",
    "USDZAR=X": "USD_ZAR",
    "USDNOK=X": "USD_NOK",
    "USDSEK=X": "USD_SEK",
    "USDDKK=X": "USD_DKK",
    "USDPLN=X": "USD_PLN",
    "USDCZK=X": "USD_CZK",
    "USDHUF=X": "USD_HUF",
    "EURJPY=X": "EUR_JPY",
    "EURGBP=X": "EUR_GBP",
    "GBPJPY=X": "GBP_JPY",
    "AUDJPY=X": "AUD_JPY",
    "CADJPY=X": "CAD_JPY",
    "CHFJPY=X": "CHF_JPY",
    "EURAUD=X": "EUR_AUD",
    "EURCAD=X": "EUR_CAD",
    "GC=F": "Gold",
    "SI=F": "Silver",
    "PL=F": "Platinum",
    "HG=F": "Copper",
    "CL=F": "WTI_Crude",
    "BZ=F": "Brent_Crude",
    "NG=F": "Natural_Gas",
    "ZC=F": "Corn",
    "ZS=F": "Soybeans",
    "ZW=F": "Wheat",
    "KC=F": "Coffee",
    "SB=F": "Sugar",
    "CC=F": "Cocoa",
    "CT=F": "Cotton",
    "LE=F": "Live_Cattle",
    "HE=F": "Lean_Hogs",
    "PA=F": "Palladium",
    "RB=F": "RBOB_Gasoline",
    "HO=F": "Heating_Oil",
    "^VIX": "VIX",
    "^TNX": "US10Y",
    "^IRX": "US3M",
    "DX-Y.NYB": "DXY",
    "^GSPC": "SP500",
    "^DJI": "DowJones",
    "^IXIC": "NASDAQ",
    "^FTSE": "FTSE100",
    "^N225": "Nikkei225",
}


def market_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELS.items()), "symbol string, label string")


def label(df: DataFrame, dimension: DataFrame, symbol: str = "symbol", out: str = "label") -> DataFrame:
    """Add the label of each symbol; a symbol without one is its own label.

    ``dimension`` has unique (symbol, label) rows. It is broadcast when the
    planner finds it small, not by force.
    """
    named = dimension.select(F.col("symbol").alias(symbol), F.col("label").alias("_label"))
    return df.join(named, symbol, "left").withColumn(out, F.coalesce("_label", symbol)).drop("_label")
