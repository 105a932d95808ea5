"""Column contracts shared by every module."""

from pyspark.sql import types as T

# One series: a delivery point's fluid inside a building.
KEY = ["id_building_primaire", "deliverypoint_id_primaire", "fluid"]
PDL_KEY = ["deliverypoint_id_primaire", "fluid"]

# --- fixed values: degree-day references, in evaluation order -------------------------------
DJU_SPECS = [("hdd", 10), ("hdd", 15), ("hdd", 18), ("cdd", 21), ("cdd", 24), ("cdd", 26)]
DJU_COLUMNS = [f"{indicator}{basis}" for indicator, basis in DJU_SPECS]
HDD_COLUMNS = [c for c in DJU_COLUMNS if c.startswith("hdd")]
CDD_COLUMNS = [c for c in DJU_COLUMNS if c.startswith("cdd")]

# --- fixed values: training status, persisted text and short code ---------------------------
STATUS_TEXT = {
    "note_000": "TrainStatus.NO_REFERENCE_DATA",
    "note_001": "TrainStatus.TOO_FEW_OBSERVATIONS",
    "note_annual_ref": "TrainStatus.OK_ANNUAL_REFERENCE",
}

# --- fixed values: model thresholds ---------------------------------------------------------
MIN_OBSERVATIONS = 6
SEASON = 12
FENCE_WIDTH = 3.0
SEASONAL_STRENGTH = 0.6
GAP_WARNING = 0.2
NORMAL_95 = 1.96
MONTH_PATTERN = r"^\d{4}-\d{2}$"


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()
_DATE, _TS = T.DateType(), T.TimestampType()

BUILDING = _struct(
    id_building_primaire=_S, platform_code=_S, building_code=_S, name=_S, latitude=_D,
    longitude=_D, organisation=_S, address=_S, city=_S, zipcode=_S, country=_S, typology=_S,
    geographical_area=_I, occupant=_I, surface=_D, reference_period_start=_DATE,
    reference_period_end=_DATE, weather_station=_S, received_at=_TS,
)
DELIVERYPOINT = _struct(
    deliverypoint_id_primaire=_S, id_building_primaire=_S, deliverypoint_code=_S,
    deliverypoint_number=_S, fluid=_S, fluid_unit=_S,
)
INVOICE = _struct(
    invoice_id_primaire=_S, invoice_code=_S, deliverypoint_id_primaire=_S, start=_DATE,
    end=_DATE, value=_D,
)
USAGE = _struct(id_building_primaire=_S, date=_DATE, type=_S, value=_D)
DEGREEDAYS = _struct(station_id=_S, period_month=_S, indicator=_S, basis=_I, value=_D)

# Non-factor columns of a model table; anything else that is not a degree-day is a factor.
STANDARD_COLUMNS = [
    *INVOICE.names,
    *(c for c in DELIVERYPOINT.names if c not in ("deliverypoint_id_primaire", "id_building_primaire", "fluid_unit")),
    "month_year", "month_year_end_date",
]

# --- fixed values: columns of the two persisted tables, in order -----------------------------
PREDICTION_COLUMNS = [
    "id_building_primaire", "deliverypoint_id_primaire", "fluid", "month_str",
    "real_consumption", "predictive_consumption", "confidence_lower95", "confidence_upper95",
    "run_id", "created_at",
]
MODEL_COLUMNS = [
    "id_building_primaire", "deliverypoint_id_primaire", "fluid", "run_id", "created_at",
    "model_family", "chosen_hdd", "chosen_cdd", "status", "b_coefficient", "a_hdd", "a_cdd",
    "annual_consumption_reference", "ME", "RMSE", "MAE", "MPE", "MAPE", "R2", "adjR2",
]

_TEXT = {
    "id_building_primaire", "deliverypoint_id_primaire", "fluid", "month_str", "run_id", "model_family",
    "chosen_hdd", "chosen_cdd", "status",
}
PREDICTIONS, MODELS = (
    _struct(**{c: _S if c in _TEXT else _TS if c == "created_at" else _D for c in columns})
    for columns in (PREDICTION_COLUMNS, MODEL_COLUMNS)
)
RUN_REQUESTS = _struct(id_building_primaire=_S, run_id=_S)
COMMITS = _struct(run_id=_S, created_at=_TS)
