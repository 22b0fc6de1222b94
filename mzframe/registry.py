"""Constants of the token format and of the controlled vocabularies, and the tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Keys of an array descriptor, limits, and default fixed points.
DESC_TYPE, DESC_ARRAY, DESC_COMP, DESC_FP, DESC_NAME, DESC_DATA, DESC_UNIT = range(7)
FORMAT_VERSION = 1
MAX_BLOB_BYTES = 64 << 20
MAX_PAYLOAD_BYTES = 16 << 20
MAX_PEAKS = 4_000_000
MAX_DEPTH = 32
MAX_ITEMS = 100_000
LINEAR_FP = 100_000
SLOF_FP = 3_600
MAX_SAFE_INTEGER = 2**53 - 1
WARN_LENGTH = 8_192

# Accession tails of data types, arrays and compressions.
FLOAT64, FLOAT32, INT32 = 1000523, 1000521, 1000519
ARRAY_MZ, ARRAY_INTENSITY, ARRAY_CHARGE, ARRAY_NON_STANDARD = 1000514, 1000515, 1000516, 1000786
ZLIB, ZSTD, SHUFFLED_ZSTD = 1000574, 1003780, 1003781
LINEAR_ZLIB, SLOF_ZLIB, PIC_ZLIB = 1002746, 1002748, 1002747
LINEAR_ZSTD, SLOF_ZSTD, PIC_ZSTD = 1003783, 1003785, 1003784

CODECS = {
    "zlib": ZLIB,
    "zstd": ZSTD,
    "byte-shuffled-zstd": SHUFFLED_ZSTD,
    "numlin-zlib": LINEAR_ZLIB,
    "numlin-zstd": LINEAR_ZSTD,
    "numslof-zlib": SLOF_ZLIB,
    "numslof-zstd": SLOF_ZSTD,
    "numpic-zlib": PIC_ZLIB,
    "numpic-zstd": PIC_ZSTD,
}
LINEAR, SLOF, PIC = (LINEAR_ZLIB, LINEAR_ZSTD), (SLOF_ZLIB, SLOF_ZSTD), (PIC_ZLIB, PIC_ZSTD)
LOSSY = (*LINEAR, *SLOF, *PIC)
DTYPES = {"float64": FLOAT64, "float32": FLOAT32, "int32": INT32}
CORE = {"MS:1000514": "mz", "MS:1000515": "intensity", "MS:1000516": "charge"}

# The arrays that each lossy transform suits.
MOBILITY_ARRAYS = (1002477, 1002816, 1002893, 1003006, 1003007, 1003008, 1003153, 1003154, 1003155, 1003156)
LINEAR_ARRAYS = (*MOBILITY_ARRAYS, 1000595, 1000617, 1002743, 1003143, 1003157, 1003158)
SLOF_ARRAYS = (1000517, 1000820, 1000821, 1002529, 1002530, 1002742, 1002744, 1002745, 4000210)
PIC_ARRAYS = (1003870,)
#: Arrays of no transform: mean charge, measured element, temperature.
OTHER_ARRAYS = (1002478, 1002716, 1000822)
ARRAYS = (ARRAY_MZ, ARRAY_INTENSITY, ARRAY_CHARGE, ARRAY_NON_STANDARD, *LINEAR_ARRAYS, *SLOF_ARRAYS, *PIC_ARRAYS, *OTHER_ARRAYS)

# Names of the arrays and of their usual units.
ARRAY_NAMES = {
    "MS:1000514": "m/z",
    "MS:1000515": "intensity",
    "MS:1000516": "charge",
    "MS:1000517": "signal to noise",
    "MS:1000595": "time",
    "MS:1000617": "wavelength",
    "MS:1000786": "non-standard data",
    "MS:1000820": "flow rate",
    "MS:1000821": "pressure",
    "MS:1000822": "temperature",
    "MS:1002477": "mean ion mobility drift time",
    "MS:1002478": "mean charge",
    "MS:1002529": "resolution",
    "MS:1002530": "baseline",
    "MS:1002716": "measured element",
    "MS:1002742": "noise",
    "MS:1002743": "sampled noise m/z",
    "MS:1002744": "sampled noise intensity",
    "MS:1002745": "sampled noise baseline",
    "MS:1002816": "mean ion mobility",
    "MS:1002893": "ion mobility",
    "MS:1003006": "mean inverse reduced ion mobility",
    "MS:1003007": "raw ion mobility",
    "MS:1003008": "raw inverse reduced ion mobility",
    "MS:1003143": "mass",
    "MS:1003153": "raw ion mobility drift time",
    "MS:1003154": "deconvoluted ion mobility",
    "MS:1003155": "deconvoluted inverse reduced ion mobility",
    "MS:1003156": "deconvoluted ion mobility drift time",
    "MS:1003157": "scanning quadrupole position lower bound m/z",
    "MS:1003158": "scanning quadrupole position upper bound m/z",
    "MS:4000210": "vacuum pump pressure",
}
UNIT_NAMES = {
    "MS:1000040": "m/z",
    "MS:1000131": "number of detector counts",
    "MS:1000132": "percent of base peak",
    "MS:1000814": "counts per second",
    "MS:1002814": "volt-second per square centimeter",
    "UO:0000010": "second",
    "UO:0000028": "millisecond",
    "UO:0000031": "minute",
}

# Names of accessions.
LABELS = {
    "MS:1000514": "m/z array",
    "MS:1000515": "intensity array",
    "MS:1000516": "charge array",
    "MS:1000517": "signal to noise array",
    "MS:1000595": "time array",
    "MS:1000617": "wavelength array",
    "MS:1000786": "non-standard data array",
    "MS:1000820": "flow rate array",
    "MS:1000821": "pressure array",
    "MS:1000822": "temperature array",
    "MS:1002529": "resolution array",
    "MS:1002530": "baseline array",
    "MS:1002742": "noise array",
    "MS:1002893": "ion mobility array",
    "MS:1003143": "mass array",
    "MS:1000511": "ms level",
    "MS:1000016": "scan start time",
    "MS:1000040": "m/z",
    "MS:1000041": "charge state",
    "MS:1000042": "peak intensity",
    "MS:1000045": "collision energy",
    "MS:1000127": "centroid spectrum",
    "MS:1000128": "profile spectrum",
    "MS:1000129": "negative scan",
    "MS:1000130": "positive scan",
    "MS:1000131": "number of detector counts",
    "MS:1000132": "percent of base peak",
    "MS:1000133": "collision-induced dissociation",
    "MS:1000285": "total ion current",
    "MS:1000500": "scan window upper limit",
    "MS:1000501": "scan window lower limit",
    "MS:1000504": "base peak m/z",
    "MS:1000505": "base peak intensity",
    "MS:1000527": "highest observed m/z",
    "MS:1000528": "lowest observed m/z",
    "MS:1000744": "selected ion m/z",
    "MS:1000795": "no combination",
    "MS:1000827": "isolation window target m/z",
    "MS:1000828": "isolation window lower offset",
    "MS:1000829": "isolation window upper offset",
    "UO:0000010": "second",
    "UO:0000028": "millisecond",
    "UO:0000031": "minute",
    "UO:0000266": "electronvolt",
}


def labels(spark: SparkSession) -> DataFrame:
    """(accession, label): a table of a fixed size."""
    return spark.createDataFrame(sorted(LABELS.items()), "accession string, label string")


def arrays(spark: SparkSession) -> DataFrame:
    """(accession, name, transform): the arrays with a name, and the transform of their lossy form; a table of a fixed size."""
    suits = {**dict.fromkeys((ARRAY_MZ, *LINEAR_ARRAYS), "linear"), **dict.fromkeys((ARRAY_INTENSITY, *SLOF_ARRAYS), "slof"), **dict.fromkeys((ARRAY_CHARGE, *PIC_ARRAYS), "pic")}
    return spark.createDataFrame([(a, n, suits.get(int(a[3:]), "raw")) for a, n in ARRAY_NAMES.items()], "accession string, name string, transform string")


def units(spark: SparkSession) -> DataFrame:
    """(accession, name): a table of a fixed size."""
    return spark.createDataFrame(sorted(UNIT_NAMES.items()), "accession string, name string")


def codecs(spark: SparkSession) -> DataFrame:
    """(name, compression, lossy, transform): a table of a fixed size."""
    kind = {**dict.fromkeys(LINEAR, "linear"), **dict.fromkeys(SLOF, "slof"), **dict.fromkeys(PIC, "pic")}
    return spark.createDataFrame([(n, c, c in LOSSY, kind.get(c, "raw")) for n, c in CODECS.items()], "name string, compression int, lossy boolean, transform string")
