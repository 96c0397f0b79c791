"""Hand-made and derived frames for the tests."""

from pyspark.sql import functions as F

from tabwright import config
from tabwright.functions.hashing import unit_hash

NOMINAL = {
    "Neighborhood": ["NAmes", "OldTown", "Edwards", "Somerst", "NridgHt", "Gilbert"],
    "MSZoning": ["RL", "RM", "FV"],
    "BldgType": ["1Fam", "Duplex", "TwnhsE"],
}


def synthetic_sales(spark, n: int, seed: int = 7):
    """Full schema with a known signal: price = 40 * quality * area / 10
    + neighbourhood effect + noise; about 5 % NULL in three columns."""
    u = lambda tag: unit_hash(F.col("Id"), f"{seed}:{tag}")
    df = spark.range(1, n + 1).withColumnRenamed("id", "Id")
    columns = {}
    for name, kind in config.data_schema_fields().items():
        if name in config.ORDINAL_LEVELS:
            levels = config.ORDINAL_LEVELS[name]
        elif kind == "string":
            levels = NOMINAL.get(name, ["a", "b", "c"])
        else:
            columns[name] = F.floor(u(name) * 100).cast(kind)
            continue
        columns[name] = F.get(F.array(*[F.lit(x) for x in levels]), F.floor(u(name) * len(levels)).cast("int"))
    columns["OverallQual"] = (1 + F.floor(u("OverallQual") * 10)).cast("int")
    columns["GrLivArea"] = (600 + F.floor(u("GrLivArea") * 2400)).cast("int")
    columns["YearBuilt"] = (1900 + F.floor(u("YearBuilt") * 110)).cast("int")
    columns["YearRemodAdd"] = (1950 + F.floor(u("YearRemodAdd") * 60)).cast("int")
    columns["YrSold"] = (2006 + F.floor(u("YrSold") * 5)).cast("int")
    columns["MoSold"] = (1 + F.floor(u("MoSold") * 12)).cast("int")
    for c in ("LotFrontage", "GarageYrBlt", "MasVnrArea"):
        columns[c] = F.when(u(c + "?") >= 0.05, columns[c])
    df = df.select("Id", *[c.alias(name) for name, c in columns.items()])
    place = F.get(F.array(*[F.lit(float(20000 * i)) for i in range(6)]), F.floor(u("Neighborhood") * 6).cast("int"))
    price = 4 * F.col("OverallQual") * F.col("GrLivArea") + place + 5000 * (u("noise") - 0.5)
    return df.withColumn("SalePrice", price.cast("double"))
