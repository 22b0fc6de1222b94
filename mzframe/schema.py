"""Types of spectra and their parts. They are fixed; nothing infers them."""

VALUE = "struct<kind: string, i: bigint, d: double, s: string>"
CV = f"struct<accession: string, value: {VALUE}, unit_accession: string>"
USER = f"struct<name: string, value: {VALUE}, type: string, unit_accession: string>"
WINDOW = f"struct<params: array<{CV}>>"
SCAN = f"struct<params: array<{CV}>, windows: array<{WINDOW}>, user_params: array<{USER}>>"
PRECURSOR = f"struct<isolation_window: {WINDOW}, selected_ions: array<{WINDOW}>, activation: {WINDOW}>"
PRODUCT = f"struct<isolation_window: {WINDOW}>"
EXTRA = "struct<dtype: string, values: array<double>>"
DESCRIPTOR = "struct<type: int, array: int, comp: int, fp: bigint, name: string, data: binary, unit: string>"
PLAN = "struct<key: string, array: int, type: int, comp: int, fp: bigint, name: string, unit: string>"
#: Columns that describe a spectrum beside its arrays.
METADATA = {
    "id": "string",
    "params": f"array<{CV}>",
    "scans": f"array<{SCAN}>",
    "scan_combination": CV,
    "precursors": f"array<{PRECURSOR}>",
    "products": f"array<{PRODUCT}>",
    "interp": "string",
    "user_params": f"array<{USER}>",
}
ARRAYS = {
    "mz": "array<double>",
    "intensity": "array<double>",
    "charge": "array<double>",
    "extra_arrays": f"map<string, {EXTRA}>",
    "array_units": "map<string, string>",
}
COLUMNS = {"default_array_length": "int", **ARRAYS, **METADATA}
SPECTRUM = ", ".join(f"{k} {v}" for k, v in COLUMNS.items())
