"""Declarative registry: which tables, columns, units, codes and policies exist.

The names below are fixed values: they are the column names users query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridhour.functions import energy

AUDIT_COLUMNS = ("updated_at", "created_at")
PENINSULA_GEO_ID = 8741

# Window of the model data and borders of its chronological split.
DATASET_START = "2020-01-01"
DATASET_END = "2026-08-15"
TRAIN_END = "2024-12-31"
VAL_END = "2025-12-31"


@dataclass(frozen=True)
class TableSpec:
    time_col: str
    prefix: str
    grain: str
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class DerivedSpec:
    name: str
    inputs: tuple[str, ...]
    formula: Callable[..., Column]

    def column(self) -> Column:
        return self.formula(*[F.col(c) for c in self.inputs])


@dataclass(frozen=True)
class ColumnPolicy:
    """Completeness policy: tolerated missing hours of critical columns, and sporadic ones."""

    critical: dict[str, int] = field(default_factory=dict)
    sporadic: frozenset[str] = frozenset()


BRONZE_TABLES: dict[str, TableSpec] = {
    "entsoe_gen_data": TableSpec(
        "datetime",
        "entsoe",
        "hourly",
        (
            "solar_mw", "wind_mw", "hydro_run_river_mw", "hydro_reservoir_mw", "pumping_gen_mw", "pumping_cons_mw",
            "biomass_mw", "waste_mw", "other_renewable_mw", "oil_mw", "gas_mw",
        ),
    ),
    "esios_gen": TableSpec(
        "datetime",
        "esios_gen",
        "hourly",
        (
            "ree_gsolter_mw", "ree_gbattery_mw", "ree_cbattery_mw", "ree_gnuclear_mw", "ree_gccgas_mw",
            "ree_gotherthermal_mw", "ree_gcoal_mw", "ree_gsolar_mw",
        ),
    ),
    "load_inter": TableSpec(
        "datetime",
        "load_inter",
        "hourly",
        (
            "ree_load", "entsoe_load", "ree_ntc_impfr", "ree_ntc_expfr", "ree_netflow_fr", "ree_ntc_imppt",
            "ree_ntc_exppt", "ree_netflow_pt", "ree_ntc_impma", "ree_ntc_expma", "ree_netflow_ma",
            "total_net_flow_mw", "gen_peninsular_mw",
        ),
    ),
    "esios_forecast_da": TableSpec(
        "datetime", "forecast", "hourly", ("demanda_mercado_prev_mw", "gen_wind_prev_mw", "gen_solar_pv_prev_mw")
    ),
    "commodities": TableSpec("fecha", "commodities", "daily", ("gas_mibgas", "co2_eua_dec", "gas_ttf_m1")),
    "era5_weather_agg": TableSpec(
        "ts",
        "era5",
        "3h",
        (
            "t2m_mean", "d2m_mean", "wind10_mean", "wind100_mean", "wind_gust10_mean", "ssrd_mean", "tcc_mean",
            "tp_mean", "msl_mean",
        ),
    ),
}
ANCHOR_TABLE = "entsoe_gen_data"

BRONZE_DERIVED = (
    DerivedSpec("calc_solar_fv_mw", ("entsoe_solar_mw", "esios_gen_ree_gsolter_mw"), energy.clean_pv),
    DerivedSpec(
        "calc_hydro_dispatch_mw", ("entsoe_hydro_reservoir_mw", "entsoe_pumping_gen_mw"), energy.dispatchable_hydro
    ),
    DerivedSpec("calc_autoconsumo_mw", ("load_inter_ree_load", "load_inter_entsoe_load"), energy.self_consumption),
)

# Leak-safe feature columns of the daily dataset, in output order.
FORECAST_COLUMNS = (
    "demanda_prev_mw", "demanda_mercado_prev_mw", "gen_wind_prev_mw", "gen_solar_pv_prev_mw",
    "gen_renovables_prev_mw", "gen_solartermica_prev_mw", "cap_baleares_prev_mw", "ntc_fr_imp_prev_mw",
    "ntc_fr_exp_prev_mw", "ntc_pt_imp_prev_mw", "ntc_pt_exp_prev_mw", "ntc_ma_imp_prev_mw", "ntc_ma_exp_prev_mw",
)
NTC_COLUMNS = (
    "ree_ntc_impfr", "ree_ntc_expfr", "ree_ntc_imppt", "ree_ntc_exppt", "ree_ntc_impma", "ree_ntc_expma",
)
COMMODITY_COLUMNS = ("gas_mibgas", "gas_ttf", "co2_ets", "carbon_api2", "co2_eua_dec", "gas_ttf_m1")
REAL_LOAD_COLUMNS = (
    "ree_load", "entsoe_load", "ree_netflow_fr", "ree_netflow_pt", "ree_netflow_ma", "total_net_flow_mw",
    "gen_peninsular_mw",
)
REAL_ENTSOE_COLUMNS = (
    "wind_mw", "pumping_cons_mw", "hydro_run_river_mw", "biomass_mw", "waste_mw", "other_renewable_mw", "oil_mw",
)
REAL_ESIOS_COLUMNS = (
    "ree_gsolter_mw", "ree_gccgas_mw", "ree_gbattery_mw", "ree_cbattery_mw", "ree_gnuclear_mw",
    "ree_gotherthermal_mw", "ree_gcoal_mw",
)
WEATHER_COLUMNS = (
    "t2m_mean", "d2m_mean", "wind10_mean", "wind100_mean", "wind_gust10_mean", "ssrd_mean", "tcc_mean", "tp_mean",
    "msl_mean",
)
KELVIN_COLUMNS = ("t2m_mean", "d2m_mean")
ENTSOE_FORECAST_COLUMNS = ("load_forecast_mw", "wind_forecast_mw", "solar_forecast_mw")
NEIGHBOUR_PRICE_COLUMNS = ("pt_entsoe", "fr_entsoe")
FORECAST_PAIRS = {
    "diff_demanda": ("demanda_prev_mw", "load_forecast_mw"),
    "diff_eolica": ("gen_wind_prev_mw", "wind_forecast_mw"),
    "diff_solar": ("gen_solar_pv_prev_mw", "solar_forecast_mw"),
}
# Published, but revised days later or published after the market closes: never a feature.
LEAKING_COLUMNS = ("demanda_residual_prev_mw", "unavailable_power_mw")

# Production type + kind of the actual-generation feed to canonical column.
GENERATION_CODES: dict[str, list[str]] = {
    "solar_mw": ["Solar|Actual Aggregated"],
    "wind_mw": ["Wind Onshore|Actual Aggregated", "Wind Offshore|Actual Aggregated"],
    "hydro_run_river_mw": ["Hydro Run-of-river and poundage|Actual Aggregated"],
    "hydro_reservoir_mw": ["Hydro Water Reservoir|Actual Aggregated"],
    "pumping_gen_mw": ["Hydro Pumped Storage|Actual Aggregated"],
    "pumping_cons_mw": ["Hydro Pumped Storage|Actual Consumption"],
    "battery_gen_mw": ["Energy storage|Actual Aggregated"],
    "battery_cons_mw": ["Energy storage|Actual Consumption"],
    "biomass_mw": ["Biomass|Actual Aggregated"],
    "waste_mw": ["Waste|Actual Aggregated"],
    "other_renewable_mw": [
        "Other renewable|Actual Aggregated", "Geothermal|Actual Aggregated", "Marine|Actual Aggregated",
    ],
    "nuclear_mw": ["Nuclear|Actual Aggregated"],
    "gas_mw": ["Fossil Gas|Actual Aggregated"],
    "coal_mw": ["Fossil Hard coal|Actual Aggregated", "Fossil Brown coal/Lignite|Actual Aggregated"],
    "oil_mw": ["Fossil Oil|Actual Aggregated"],
    "other_thermal_mw": [
        "Other|Actual Aggregated", "Fossil Coal-derived gas|Actual Aggregated", "Fossil Oil shale|Actual Aggregated",
        "Fossil Peat|Actual Aggregated",
    ],
}
GENERATION_POLICY = ColumnPolicy(
    {"solar_mw": 0, "wind_mw": 0, "nuclear_mw": 0, "gas_mw": 0},
    frozenset(
        {
            "coal_mw", "oil_mw", "biomass_mw", "waste_mw", "hydro_run_river_mw", "other_renewable_mw",
            "other_thermal_mw", "pumping_gen_mw", "pumping_cons_mw", "battery_gen_mw", "battery_cons_mw",
        }
    ),
)

# Load and interconnection: border balances are energy (sum), the rest is power (mean).
LOAD_COLUMNS = (
    "ree_load", "entsoe_load", "ree_netflow_fr", "ree_netflow_pt", "ree_netflow_ma", "ree_ntc_impfr",
    "ree_ntc_expfr", "ree_ntc_imppt", "ree_ntc_exppt", "ree_ntc_impma", "ree_ntc_expma",
)
LOAD_SUMMED = frozenset({"ree_netflow_fr", "ree_netflow_pt", "ree_netflow_ma"})
LOAD_POLICY = ColumnPolicy({c: 1 for c in LOAD_COLUMNS})

# Programme tables: MWh, so everything sums.
PROGRAMME_COLUMNS: dict[str, tuple[str, ...]] = {
    "esios_pbf_gen": (
        "wind_mw", "solar_pv_mw", "solar_thermal_mw", "hydro_no_ugh_mw", "hydro_ugh_mw", "total_hydro_mw",
        "pumping_gen_mw", "pumping_cons_mw", "biomass_mw", "biogas_mw", "waste_mw", "other_renew_mw", "nuclear_mw",
        "ccgt_mw", "cogen_mw", "coal_mw", "fuel_gas_mw", "hybrid_mw", "total_gen_mw", "unavailable_power_mw",
    ),
    "esios_pbf_load_inter": (
        "demand_free_market_mw", "demand_reference_mw", "demand_direct_mw", "demand_aux_mw", "total_demand_mw",
        "net_flow_fr_mw", "net_flow_pt_mw", "net_flow_ma_mw", "net_flow_ad_mw", "total_net_flow_mw", "baleares_mw",
    ),
    "esios_pbf_bilateral": (
        "bil_hydro_ugh_mw", "bil_hydro_no_ugh_mw", "bil_nuclear_mw", "bil_wind_onshore_mw", "bil_solar_pv_mw",
        "bil_solar_thermal_mw", "bil_cogen_mw", "bil_petro_coal_mw", "bil_biomass_mw", "bil_biogas_mw",
        "bil_hybrid_mw", "bil_coal_mw", "bil_retail_free_sales_mw", "bil_generic_sales_mw", "bil_total_sales_mw",
        "bil_retail_free_buy_mw", "bil_retail_last_resort_mw", "bil_direct_consumer_mw", "bil_generic_buy_mw",
        "bil_total_purchases_mw",
    ),
}

# Clean generation table: output column -> (source, expression inputs).
GENERATION_OUTPUT: dict[str, tuple[str, str]] = {
    "ree_gsolter": ("esios", "ree_gsolter_mw"),
    "ent_gwind": ("entsoe", "wind_mw"),
    "ent_ghydroriver": ("entsoe", "hydro_run_river_mw"),
    "ent_cpumping": ("entsoe", "pumping_cons_mw"),
    "ree_gbattery": ("esios", "ree_gbattery_mw"),
    "ree_cbattery": ("esios", "ree_cbattery_mw"),
    "ent_gbiomass": ("entsoe", "biomass_mw"),
    "ent_gwaste": ("entsoe", "waste_mw"),
    "ent_gotherrenew": ("entsoe", "other_renewable_mw"),
    "ree_gnuclear": ("esios", "ree_gnuclear_mw"),
    "ree_gccgt": ("esios", "ree_gccgas_mw"),
    "ree_gotherthermal": ("esios", "ree_gotherthermal_mw"),
    "ree_gcoal": ("esios", "ree_gcoal_mw"),
    "ent_goil": ("entsoe", "oil_mw"),
}

CAPACITY_COLUMNS = ("hydro_mw", "pump_mw", "nuclear_mw", "coal_mw", "ccgt_mw", "fuel_mw")
SNAPSHOT_COLUMNS = (
    "hydro_mw", "pump_mw", "nuclear_mw", "coal_antracita_mw", "ccgt_mw", "fuel_mw", "gas_turbine_mw",
)

FRONT_RULES = {"EUA": "front_december", "TTF": "next_month"}
FRONT_TARGETS = {"EUA": "co2_eua_dec", "TTF": "gas_ttf_m1"}

PRICE_RANGE = (-1000.0, 6000.0)
TRADE_PRICE_RANGE = (-100.0, 2000.0)
CRITICAL_PRICES = ("es_omie", "es_esios", "es_entsoe")
# Zones that a source publishes; other zone/source columns of a price table are ignored.
SOURCE_ZONES = {"esios": ("ES", "PT", "FR", "DE_LU", "BE", "NL"), "omie": ("ES", "PT")}

# Yearly market level of the emission allowance, EUR/t, for validation.
CO2_REFERENCE = {2020: 25, 2021: 53, 2022: 81, 2023: 84, 2024: 65, 2025: 75, 2026: 80}

GRID_BOX = {"lat": (36.0, 44.0), "lon": (-9.5, 4.5)}
GRID_CHANNELS = ("t2m", "d2m", "u10", "v10", "u100", "v100", "wind_gust10", "ssrd", "tcc", "tp", "msl")

# Pairs of sources that measure the same thing: kept source and columns, other source and columns.
CONTROL_PAIRS = {
    "solar_total": ("esios_gen", ("ree_gsolar_mw", "ree_gsolter_mw"), "entsoe_gen_data", ("solar_mw",)),
    "eolica": ("entsoe_gen_data", ("wind_mw",), "esios_gen", ("ree_gwind_mw",)),
    "bombeo_gen": ("entsoe_gen_data", ("pumping_gen_mw",), "esios_gen", ("ree_gpumping_mw",)),
    "bombeo_cons": ("entsoe_gen_data", ("pumping_cons_mw",), "esios_gen", ("ree_cpumping_mw",)),
    "hidraulica": (
        "entsoe_gen_data", ("hydro_run_river_mw", "hydro_reservoir_mw"), "esios_gen", ("ree_ghidro_mw",),
    ),
    "nuclear": ("entsoe_gen_data", ("nuclear_mw",), "esios_gen", ("ree_gnuclear_mw",)),
}

# Geographic ids that are totals, and name patterns of systems outside the peninsula.
AGGREGATE_GEOS = (3, 8741)
OFF_PENINSULA_NAMES = (
    "canaria", "balear", "ceuta", "melilla", "tenerife", "gran canaria", "lanzarote", "fuerteventura", "la palma",
    "la gomera", "el hierro", "mallorca", "menorca", "ibiza", "formentera",
)
