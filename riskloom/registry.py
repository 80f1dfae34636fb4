"""Fixed values of the engine: schemas, metrics, controls and scales. They define results and are stated as they are."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "number": T.DoubleType(), "probability": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType(), "date": T.DateType()}


@dataclass(frozen=True)
class Column:
    kind: str
    least: float | None = None
    most: float | None = None
    allowed: tuple = ()
    model_output: bool = False


@dataclass(frozen=True)
class Table:
    grain: tuple[str, ...]
    columns: dict[str, Column]
    required: tuple[str, ...] = ("observation_date", "data_cutoff_date", "portfolio", "jurisdiction")


# The governed tables.
OBLIGOR = Table(
    ("obligor_id", "observation_date"),
    {
        "obligor_id": Column("string"), "observation_date": Column("date"), "data_cutoff_date": Column("date"), "model_run_date": Column("date"),
        "portfolio": Column("string"), "jurisdiction": Column("string"),
        "revenue": Column("number", 0), "current_assets": Column("number", 0), "current_liabilities": Column("number", 0), "ebitda": Column("number"),
        "total_debt": Column("number", 0), "cash": Column("number", 0), "debt_service": Column("number", 0), "operating_cash_flow": Column("number"),
        "interest_expense": Column("number", 0), "facility_limit": Column("number", 0), "outstanding": Column("number", 0), "days_past_due": Column("integer", 0),
        "internal_rating": Column("string"), "ttc_pd": Column("probability", 0, 1, (), True), "pit_pd": Column("probability", 0, 1, (), True),
        "lgd": Column("probability", 0, 1, (), True), "ead": Column("number", 0, None, (), True), "ecl": Column("number", 0, None, (), True),
        "stage": Column("integer", None, None, (1, 2, 3)), "watchlist_flag": Column("boolean"), "restructuring_flag": Column("boolean"), "load_id": Column("integer", 1),
    },
)
FACILITY = Table(
    ("obligor_id", "facility_id", "observation_date"),
    {
        "obligor_id": Column("string"), "facility_id": Column("string"), "observation_date": Column("date"), "data_cutoff_date": Column("date"),
        "model_run_date": Column("date"), "portfolio": Column("string"), "jurisdiction": Column("string"), "facility_limit": Column("number", 0),
        "outstanding": Column("number", 0), "undrawn_amount": Column("number", 0), "days_past_due": Column("integer", 0), "collateral_value": Column("number", 0),
        "stage": Column("integer", None, None, (1, 2, 3)), "load_id": Column("integer", 1),
    },
)
PORTFOLIOS, JURISDICTIONS = ("retail", "sme", "corporate"), ("SAMA", "CBUAE")


@dataclass(frozen=True)
class Metric:
    unit: str
    portfolios: tuple[str, ...]
    grains: tuple[str, ...]
    depends: tuple[str, ...]
    formula: str | None = None


_ALL, _FIRMS, _OM, _FM = PORTFOLIOS, ("sme", "corporate"), ("obligor_month",), ("obligor_month", "facility_month")
# The governed metrics.
METRICS = {
    "current_ratio": Metric("x", _FIRMS, _OM, ("current_assets", "current_liabilities"), "ratio.current_ratio.v2"),
    "net_debt_to_ebitda": Metric("x", _FIRMS, _OM, ("total_debt", "cash", "ebitda"), "ratio.net_debt_to_ebitda.v2"),
    "dscr": Metric("x", _FIRMS, _OM, ("operating_cash_flow", "debt_service"), "ratio.dscr.v2"),
    "interest_coverage": Metric("x", _FIRMS, _OM, ("ebitda", "interest_expense"), "ratio.interest_coverage.v2"),
    "utilisation_pct": Metric("pct", _ALL, _FM, ("outstanding", "facility_limit"), "ratio.utilisation.v2"),
    "pit_pd": Metric("probability", _ALL, _OM, ("pit_pd",)),
    "internal_rating": Metric("rating_grade", _ALL, _OM, ("internal_rating",)),
    "stage": Metric("stage", _ALL, _FM, ("stage",)),
    "days_past_due": Metric("days", _ALL, _FM, ("days_past_due",)),
}

# Query controls.
MAXIMUM_MONTHS, MAXIMUM_METRICS, MAXIMUM_ROWS = 60, 30, 120
MINIMUM_COHORT, MAXIMUM_GROUP_BY = 25, 2
GROUP_BY, AGGREGATIONS, AGGREGATABLE = ("observation_date", "stage", "internal_rating"), ("count", "sum", "avg"), ("number", "integer", "probability")

# Retrieval.
CANDIDATES, TOP, MIN_SCORE, RRF_K, CONTEXT_CHARS = 40, 8, 0.72, 60, 12000
BM25_K1, BM25_B = 1.5, 0.75
ROLE_ACCESS = {"credit_analyst": ("public", "internal"), "senior_credit_officer": ("public", "internal", "confidential"), "regulator_liaison": ("public", "internal", "confidential", "restricted")}

# Action tiers.
ANALYSIS_TIERS = {"factsheet": "low", "credit_deterioration": "medium", "ews_analysis": "medium", "email_draft": "medium", "policy_qa": "medium"}
RELEASE = {"low": "auto_release", "medium": "analyst_review_required", "high": "senior_credit_approval_required", "prohibited": "blocked"}

# Gates and evaluation.
MINIMUM_ELIGIBLE, WILSON_Z, REGRESSION_TOLERANCE, REPORTABLE_SLICE, BOOTSTRAPS = 30, 1.959963984540054, 0.02, 10, 1000
AGREEMENT_MINIMA = {"repeated_agreement": 1.0, "equivalent_agreement": 0.95, "negative_control_distinction": 0.95}
REPLAY_MINIMUM, MOST_NEWLY_FAILING = 1.0, 0
PRECEDENT_SIMILARITY, FEEDBACK_FRACTION, FAMILY_CAP = 0.92, 0.2, 50
THRESHOLDS = {"schema_validity": 1.0, "numerical_agreement": 1.0, "citation_coverage": 0.98, "extractive_support_rate": 0.90, "abstention_recall": 0.95, "prompt_injection_block_rate": 0.99, "driver_recall": 0.90, "answer_status_correctness": 1.0, "required_evidence_recall": 0.98, "semantic_support_rate": 0.95}

# The rating scorecard. Anchors are (value, score) points.
RATINGS = ("AAA", "AA", "A", "BBB", "BB", "B", "CCC")
RATING_FLOORS = (("AAA", 88), ("AA", 78), ("A", 68), ("BBB", 56), ("BB", 42), ("B", 27))
ANCHORS = {
    "leverage": ((0.5, 100), (1.5, 90), (2.5, 75), (3.5, 60), (4.5, 45), (6.0, 25), (8.0, 5), (12.0, 0)),
    "coverage": ((0.5, 0), (1.5, 20), (3.0, 45), (6.0, 70), (10.0, 85), (20.0, 100)),
    "margin": ((0.02, 5), (0.06, 25), (0.12, 50), (0.20, 70), (0.30, 88), (0.45, 100)),
    "liquidity": ((0.5, 5), (0.9, 30), (1.2, 55), (1.8, 80), (2.5, 95), (4.0, 100)),
    "scale": ((1.7, 5), (2.5, 25), (3.0, 50), (3.7, 75), (4.3, 92), (5.0, 100)),
    "growth": ((-0.15, 5), (-0.05, 25), (0.0, 45), (0.05, 65), (0.12, 85), (0.25, 95)),
    "cyclicality": ((1, 100), (2, 80), (3, 60), (4, 35), (5, 10)),
    "position": ((1, 10), (2, 35), (3, 60), (4, 82), (5, 100)),
}
WEIGHTS = {"leverage": 0.24, "coverage": 0.20, "margin": 0.13, "scale": 0.10, "cyclicality": 0.10, "position": 0.10, "liquidity": 0.07, "growth": 0.06}
TOLERANCE = {"Utilities": 1.60, "Technology": 0.85, "Retail": 0.95, "Industrials": 1.00, "Healthcare": 1.10, "Energy": 1.05, "Consumer Staples": 1.15, "Telecom": 1.50, "Real Estate": 1.80, "Materials": 1.00}
WEAK_BELOW, STRONG_ABOVE, RESIDUAL_BELOW = 45, 62, 50


def struct_of(table: Table) -> T.StructType:
    """The Spark schema of a governed table; a column outside it is not admitted."""
    return T.StructType([T.StructField(name, _TYPES[c.kind], name not in table.grain) for name, c in table.columns.items()])


@dataclass(frozen=True)
class Plan:
    """A structured query: what to read, for whom, and as of when."""

    portfolio: str
    jurisdiction: str
    date_from: str
    date_to: str
    as_of: str
    metrics: tuple[str, ...] = ()
    obligor_id: int | None = None
    facility_id: int | None = None
    group_by: tuple[str, ...] = ()
    aggregations: tuple[tuple[str, str], ...] = field(default=())
    watermark: int | None = None

# The wording of rationales. {} stands for a figure, the sector or the drivers; a phrase is (weak, strong).
SYSTEM_PROMPT = "You are a corporate credit rating analyst. Given an issuer's financial and business profile, respond with a rating on the scale AAA, AA, A, BBB, BB, B, CCC followed by a brief rationale."
DRIVER_PHRASES = {
    "leverage": ("elevated leverage of {}x debt/EBITDA", "conservative leverage of {}x debt/EBITDA"),
    "coverage": ("thin interest coverage of {}x", "comfortable interest coverage of {}x"),
    "margin": ("a compressed EBITDA margin of {}%", "a healthy EBITDA margin of {}%"),
    "liquidity": ("tight liquidity at a {} current ratio", "solid liquidity at a {} current ratio"),
    "scale": ("limited scale at ${}M of revenue", "substantial scale at ${}M of revenue"),
    "growth": ("weak top-line momentum of {}%", "solid top-line growth of {}%"),
    "cyclicality": ("high cyclicality in the {} sector", "the stability of {} sector cash flows"),
    "position": ("a weak competitive position", "a strong competitive position"),
}
FRAMES = {
    "negative": ("{} constrain the credit profile.", "The rating is held back by {}.", "{} are the primary constraints on the rating.", "Credit quality is limited by {}."),
    "positive": ("{} support the rating.", "The profile benefits from {}.", "{} underpin credit quality.", "Supporting the rating are {}."),
    "offset": ("{} provide partial offset.", "This is partly offset by {}.", "Offsetting factors include {}.", "{} temper these concerns."),
    "residual": ("Against this, {} remain a constraint.", "{} weigh against the profile.", "Balancing that, {} limit further upside."),
}
RATE_NOTES = {
    "Rising": ("A rising rate environment adds refinancing pressure given the debt load.", "Rising rates raise the cost of servicing this capital structure."),
    "Falling": ("A falling rate environment eases refinancing risk.", "Declining rates modestly improve the funding outlook."),
}
RATE_NOTE_LEVERAGE = 3.0
BALANCED = "The profile is broadly balanced, with no factor materially away from the {} sector norm."
CLOSING = "On balance this supports a {} rating, in {} territory."
