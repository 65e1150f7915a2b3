"""Constants of the factor engine: lexicons, roles, weights and horizons."""

from __future__ import annotations

from dataclasses import dataclass, field

# A sentence that has one of these, also inside a word, speaks of the future.
GUIDANCE_KEYWORDS = (
    "anticipate", "anticipated", "anticipates", "expect", "expected", "expecting", "expects", "fiscal year", "forecast", "forecasting",
    "full year", "going forward", "guidance", "next quarter", "outlook", "remainder of", "second half",
)

# Descriptions of executives.
EXECUTIVE_KEYWORDS = (
    "ceo", "cfo", "chairman", "chief executive", "chief financial", "chief operating", "coo", "director of investor", "evp",
    "executive vice president", "head of", "investor relations", "president", "senior vice president", "svp", "vice chairman",
)

# Descriptions of analysts.
ANALYST_KEYWORDS = (
    "analyst", "baird", "bank of america", "barclays", "bernstein", "bmo", "bofa", "capital", "citigroup", "cowen", "deutsche bank", "evercore",
    "goldman sachs", "hsbc", "jefferies", "melius", "mizuho", "morgan stanley", "oppenheimer", "partners", "piper sandler", "raymond james",
    "rbc", "research", "securities", "td cowen", "truist", "ubs", "wells fargo", "wolfe research",
)

# Words of uncertainty. The last four have spaces, so no single token equals them.
UNCERTAINTY_WORDS = (
    "ambiguity", "ambiguous", "approximately", "concern", "concerns", "contingent", "could", "depend", "depending", "depends", "doubt", "doubtful",
    "exposure", "fluctuate", "fluctuating", "imprecise", "indefinite", "may", "might", "perhaps", "possible", "possibly", "risk", "risks", "risky",
    "uncertain", "uncertainty", "unclear", "unpredictable", "variable", "volatile", "volatility",
    "cannot predict", "no assurance", "no guarantee", "subject to",
)

# Weights of z-scores. Columns that a table lacks are skipped, so the first preset uses only the last.
WEIGHTS = {"finbert_qa_net": 0.40, "finbert_prep_net": 0.35, "lm_uncertainty": -0.25}
LEGACY_WEIGHTS = {"guidance_net": 0.40, "qa_ceo_net": 0.30, "prep_net": 0.20, "lm_uncertainty": -0.10}

# Markers that a page holds a transcript.
PAGE_MARKERS = ("operator", "prepared remarks", "question", "q&a")

# The sectors of the companies covered by default.
SECTORS = {
    "AAPL": "Technology", "AMZN": "Consumer Discretionary", "GOOGL": "Technology", "JPM": "Financials", "META": "Communication Services",
    "MSFT": "Technology", "NVDA": "Technology", "TSLA": "Consumer Discretionary", "UNH": "Healthcare", "V": "Financials",
}


@dataclass(frozen=True)
class SignalConfig:
    """What a signal is built from. ``digits`` rounds between steps, so sums in another order rank the same."""

    columns: tuple[str, ...] = ("guidance_net", "qa_ceo_net", "prep_net", "lm_uncertainty")
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    horizons: tuple[int, ...] = (1, 5, 20)
    winsor: tuple[float, float] = (0.025, 0.975)
    buckets: int = 5
    digits: int | None = None
