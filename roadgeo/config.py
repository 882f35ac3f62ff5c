"""Constants and the parameter bag."""

from __future__ import annotations

from dataclasses import dataclass, field

# Thresholds, ceilings and factors that results depend on.
FEET_PER_METER = 3.28084
DEGREE_OF_CURVE = 1746.38  # degree of curve x radius in metres
METERS_PER_MILE, METERS_PER_MILE_CHUNK = 1609.344, 1609.34
EARTH_RADIUS_MILES = 3958.8
DEGREE_BINS = (3.5, 5.5, 8.5, 14.0, 28.0)
GRADE_BINS = (0.5, 2.5, 4.5, 6.5, 8.5)
SUPERELEVATION_FT = ((1500.0, 8.0), (3000.0, 6.0), (6000.0, 4.0), (99999.0, 2.0))
SIGHT_EYE_FT, SIGHT_OBJECT_FT, SIGHT_SEARCH_FT, BLIND_FT = 3.5, 2.0, 1500.0, 400.0
TOPOLOGY_RADIUS_DEG, GRADE_SEPARATED_FT, AT_GRADE_FT = 4.5e-5, 10.0, 5.0
STRUCTURE_RADIUS_M, CLEARANCE_RADIUS_DEG, DECK_FT = 0.00015 * 111320, 0.0002, 4.0
VOID_M = -1000.0  # below it a raster cell is a void
SWEEP_FACTORS = (100, 200, 400, 600, 800, 1000, 1200, 1400, 1600, 1800, 2000, 2500, 3000, 4000, 4500)
V_RMSE_CEILING_FT = (4.0, 4.5, 3.5, 3.5, 4.0, 4.0, 4.0)
H_RMSE_CEILING_FT = (3.5, 3.5, 3.8, 3.8, 5.0, 5.5, 5.5)
V_DEVIATION_FT = (35.0, 30.0, 15.0, 12.0, 15.0, 15.0, 15.0)
H_DEVIATION_FT = (15.0, 15.0, 22.0, 22.0, 15.0, 15.0, 20.0)
MOUNTAIN_EXTRA_FT, FLAT_TERRAIN_FT, ELBOW_FLAT_FT, EARLY_EXIT_FAILS = 8.0, 0.05, 0.15, 3
CONFIDENCE_CAPS = {"composite_fallback": 25, "highest_safe": 50, "flat_curve": 50, "absolute_fallback": 5}
DEGREE_FT, CURVE_VARIATION = 364_000.0, 0.05  # feet of a degree of latitude, mean turn of heading
FALLBACK_WARN, FALLBACK_ALERT, WEAK_CONFIDENCE, NEAR_CEILING_PCT = 0.20, 0.35, 40, 85.0
H_SPLINE = (400, 200, 400, 400, 200, 200, 400)
V_SPLINE = (1400, 1400, 1400, 1400, 1000, 1000, 1000)

#: Columns of an audit row of a calibration, in order.
AUDIT_COLUMNS = (
    "timestamp", "state_fips", "f_sys", "mode", "is_mountain_state", "total_chunks", "sample_chunks", "v_rmse_ceiling", "h_rmse_ceiling", "maxv_ceiling", "maxh_ceiling", "n_evaluated", "n_passing", "passing_factors", "rmse_rise",
    "early_exit_factor", "selection_method", "selected_factor", "peak_elbow_distance", "elbow_distance_profile", "v_rmse_at_baseline", "h_rmse_at_baseline", "maxv_at_baseline", "maxh_at_baseline", "curvevar_at_baseline",
    "v_rmse_at_selected", "h_rmse_at_selected", "maxv_at_selected", "maxh_at_selected", "curvevar_at_selected", "std_v_rmse_at_selected", "std_h_rmse_at_selected", "last_passing_factor", "v_rmse_at_last_passing",
    "h_rmse_at_last_passing", "maxv_at_last_passing", "maxh_at_last_passing", "national_default_factor", "deviation_from_default", "ceiling_proximity_pct", "confidence_score", "override_recommended",
)

#: Canonical column and the names that a source may use for it, compared without case.
ALIASES = {
    "RouteId": ("route_id", "routeid", "route", "id"),
    "Start_MP": ("begin_point", "start_mp", "bmp", "begin", "beg_mp"),
    "End_MP": ("end_point", "end_mp", "emp", "end"),
    "FSystem": ("f_system", "fsystem", "func_sys"),
    "Facility_Type": ("facility_type", "fac_type", "facility_typ", "facilitytype"),
    "Structure_Type": ("structure_type", "structuretype", "struct_typ"),
}
GEOMETRY_NAMES = ("wkt", "wkt_zm", "geometry", "shape", "the_geom", "line")
STATE_NAMES = ("stateid", "State_FIPS", "StateFIPS", "STATEID")
NO_STATE = ("LOCAL", "ALL", "AL", "00", "")


@dataclass(frozen=True)
class Params:
    """Run parameters in imperial units; metric twins are properties."""

    densify_ft: float = 5.0
    calibrate_ft: float = 10.0
    savgol_window: int = 21
    trim_curve_ends: bool = True
    h_min_delta: float = 3.5
    h_min_length_ft: float = 100.0
    h_max_radius_ft: float = 165_000.0
    v_threshold: float = 0.002
    v_min_length_ft: float = 200.0
    v_gap: int = 5
    v_min_grade_change: float = 1.5
    v_min_offset_ft: float = 0.10
    regression_ft: float = 500.0
    trend_ft: float = 1000.0
    dip_ft: float = 6.5
    bridge_ft: float = 8200.0
    anchor_m: float = 0.15
    merge: bool = False
    merge_gap_ft: float = 600.0
    snap_deg: float = 1e-3
    merge_chunks_ft: float = 500.0
    state: str = ""
    factors: dict = field(default_factory=dict)

    def metres(self, name: str) -> float:
        """A length given in feet, in metres."""
        return getattr(self, name) / FEET_PER_METER


def build_params(user: dict | None = None, state: str = "", state_factors: dict | None = None, ignore_user_factors: bool | None = None) -> Params:
    """Defaults, overlaid by the user's values that aren't blank, overlaid by the state's smoothing factors.

    The state's factors win for a real state unless ignore_user_factors is False; numbers given as text are cast.
    """
    known, out, factors = Params(), {}, {}
    for k, v in (user or {}).items():
        if v is None or v == "":
            continue
        if k.upper().startswith(("H_SMOOTH_FACTOR", "V_SMOOTH_FACTOR")):
            factors[k.upper()] = int(float(v))
        elif hasattr(known, k):
            kind = type(getattr(known, k))
            out[k] = (str(v).lower() in ("true", "1", "yes")) if kind is bool else kind(float(v)) if kind in (int, float) else v
    if "savgol_window" in out:
        out["savgol_window"] = max(5, out["savgol_window"])
    if state not in NO_STATE and ignore_user_factors is not False:
        factors |= {k: int(v) for k, v in (state_factors or {}).get(state.zfill(2), {}).items()}
    return Params(**out, state=state, factors=factors)


def smoothing_factor(params: Params, mode: str, f_system: int) -> int:
    """The factor of a mode ('H' or 'V') for a functional system: its own, else the base, else the default."""
    fs = f_system if 1 <= f_system <= 7 else 1
    base = (H_SPLINE if mode == "H" else V_SPLINE)[fs - 1]
    name = f"{mode}_SMOOTH_FACTOR"
    return params.factors.get(name if fs == 1 else f"{name}_FS{fs}", params.factors.get(name, base))
