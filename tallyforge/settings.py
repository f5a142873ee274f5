"""Parameters of an evaluation: prices, weights, reserved words, sizes."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

# US dollars per 1,000 tokens (input, output).
TOKEN_PRICES = {
    "gpt-4": ("0.03", "0.06"),
    "gpt-4-turbo": ("0.01", "0.03"),
    "gpt-3.5-turbo": ("0.0015", "0.002"),
    "gpt-3.5-turbo-16k": ("0.003", "0.004"),
}
FALLBACK_PRICE_MODEL = "gpt-3.5-turbo"
DEFAULT_MODELS = ("gpt-4", "gpt-3.5-turbo")
NO_WINNER = "No valid code found"

# Keys of a verdict that name no model.
RESERVED_VERDICT_KEYS = ("winner", "winner_reasoning", "loser_reasoning")

# Text categories of a code verdict, in display order.
CODE_CATEGORIES = (
    "code_quality",
    "test_performance",
    "security_analysis",
    "style_assessment",
    "strengths",
    "weaknesses",
)

# A dimension table is broadcast only when it is counted to be at most this long and
# this large as text.
BROADCAST_ROW_LIMIT = 100_000
BROADCAST_BYTE_LIMIT = 16 << 20


@dataclass(frozen=True)
class ScoreWeights:
    """Weights of the final code score and the mark scale of text verdicts."""

    functionality: float = 0.7
    style: float = 0.3
    penalty_per_issue: float = 0.1
    mark_scale: int = 5


@dataclass(frozen=True)
class PriceBook:
    """Prices held by the driver; its length is therefore known, not guessed."""

    per_1k: dict[str, tuple[str, str]] = field(default_factory=lambda: dict(TOKEN_PRICES))
    fallback_model: str = FALLBACK_PRICE_MODEL

    def rows(self) -> list[tuple[str, Decimal, Decimal]]:
        return [(m, Decimal(i), Decimal(o)) for m, (i, o) in self.per_1k.items()]

    @property
    def fallback(self) -> tuple[Decimal, Decimal]:
        price_in, price_out = self.per_1k[self.fallback_model]
        return Decimal(price_in), Decimal(price_out)
