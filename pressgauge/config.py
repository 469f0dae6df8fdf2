"""All tunable values of the pipeline, with their defaults."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from pathlib import Path

# Keyword lists, anchors, topic profiles and thresholds that results depend on.

STRONG_KEYWORDS = (
    "inflation",
    "price pressure",
    "price pressures",
    "price rise",
    "price rises",
    "cost of living",
    "mortgage",
    "mortgages",
    "rent",
    "rents",
    "house prices",
    "housing market",
    "wages",
    "pay rise",
    "pay rises",
    "salary",
    "salaries",
    "labour market",
    "labor market",
    "unemployment",
    "credit",
    "borrowing",
    "debt",
    "loan",
    "loans",
    "energy bills",
    "food prices",
    "interest rates",
)

WEAK_KEYWORDS = (
    "jobs",
    "employment",
    "vacancies",
    "spending",
    "saving",
    "savings",
    "consumer",
    "business",
    "firms",
    "investment",
    "output",
    "demand",
    "construction",
    "productivity",
    "retail",
)

URL_TERMS = (
    "business",
    "money",
    "finance",
    "property",
    "housing",
    "mortgage",
    "economy",
    "cost-of-living",
    "energy",
    "consumer",
)

POSITIVE_ANCHORS = (
    "A local or regional news story about inflation, prices, food costs, energy bills, "
    "cost of living pressure, or changes in household purchasing power.\n",
    "A news story about household finances, borrowing, debt, loans, consumer credit, "
    "savings, or financial pressure on households.\n",
    "A regional economic story about wages, jobs, labour market conditions, business demand, "
    "output, investment, or changes in local economic activity.\n",
    "A story about housing costs, rents, mortgages, affordability, house prices, "
    "or construction conditions affecting local households or firms.\n",
)

NEGATIVE_ANCHORS = (
    "A local sports story, match report, transfer story, player interview, or club news item.\n",
    "A crime, court, police, fire, accident, emergency, or breaking incident report.\n",
    "A culture, entertainment, theatre, television, music, festival, or review article.\n",
    "A property listing, lifestyle promotion, shopping guide, advertorial, or consumer deal page.\n",
    "A general local community story about schools, charity events, local politics, "
    "celebrations, or public notices with no real economic analysis.\n",
)

BOILERPLATE_PATTERNS = (
    r"sign up to (our|the) [^.?!]{0,120}",
    r"subscribe [^.?!]{0,120}",
    r"read more[: ]?",
    r"image: [^.?!]{0,120}",
    r"share your email [^.?!]{0,120}",
    r"watch more of our videos [^.?!]{0,120}",
    r"visit shots! now",
)

OTHER_TOPIC = "other_econ"
UNASSIGNED = "unassigned"
NO_LEADER = "No positive topic signal"
CANDIDATE_SOURCES = ("strong_keyword", "weak_keyword", "url_section", "weak_keyword+url_section")
REVIEW_GROUPS = ("boe_topic", "other_econ", "rejected_candidate")

RAW_COLUMNS = (
    "unique_article_id",
    "article_text",
    "domain",
    "resolved_url",
    "article_author",
    "article_date",
    "article_id",
    "duplicate_group",
    "twitter",
    "twitter_id",
    "tweet_url",
    "tweet_date",
    "retweet_count",
    "reply_count",
    "like_count",
    "quote_count",
    "impression_count",
    "LAD",
    "main_LAD",
    "owner",
)


@dataclass(frozen=True)
class Topic:
    name: str
    description: str = ""
    keywords: tuple[str, ...] = ()
    seed_examples: tuple[str, ...] = ()


TOPICS = (
    Topic(
        "Inflation and expectations",
        "News about rising or falling prices, inflation expectations, cost-of-living concerns, "
        "and public perceptions of whether prices will keep increasing. The topic should capture "
        "stories that shape households' and firms' inflation narratives in regional media.\n",
        (
            "inflation",
            "prices",
            "price rises",
            "cost of living",
            "price pressure",
            "expected prices",
            "household expectations",
            "inflation outlook",
        ),
        (
            "Local families say weekly shopping costs keep rising and expect bills to stay high through winter.",
            "Businesses warn that input prices are still rising and customers now expect further increases.",
        ),
    ),
    Topic(
        "Wages, labour market and services inflation",
        "News about wages, vacancies, hiring, labour shortages, unemployment, and service-sector pay pressures. "
        "This topic matters because wage growth and labour market tightness can feed into persistent inflation, "
        "especially in services.\n",
        (
            "wages",
            "pay rise",
            "salaries",
            "labour market",
            "labor market",
            "vacancies",
            "hiring",
            "unemployment",
            "staff shortages",
            "service sector",
        ),
        (
            "Restaurants and care providers report that they must raise pay to retain staff.",
            "Regional employers struggle to fill vacancies while workers ask for higher wages.",
        ),
    ),
    Topic(
        "Household spending and saving",
        "News about consumer demand, retail activity, household budgets, savings, and discretionary spending. "
        "It should capture whether households are cutting back, spending more cautiously, or dipping into savings.\n",
        (
            "consumer spending",
            "retail",
            "saving",
            "savings",
            "household budgets",
            "discretionary spending",
            "shoppers",
            "demand",
            "consumption",
        ),
        (
            "High street retailers report weaker footfall as households cut non-essential purchases.",
            "Families say they are using savings to cope with higher monthly bills.",
        ),
    ),
    Topic(
        "Housing, mortgages, rents and construction",
        "News about rents, mortgages, housing affordability, house prices, residential construction, "
        "and the local housing market. The topic covers both costs faced by households and supply-side "
        "developments in homebuilding.\n",
        (
            "rent",
            "rents",
            "mortgage",
            "mortgages",
            "house prices",
            "housing market",
            "landlords",
            "tenants",
            "construction",
            "homebuilding",
        ),
        (
            "Renters face another jump in monthly rents while landlords cite higher mortgage costs.",
            "Builders delay projects as financing and material costs make housing schemes harder to deliver.",
        ),
    ),
    Topic(
        "Business demand, output and investment",
        "News about local business activity, orders, output, production, expansion plans, and investment. "
        "This topic reflects whether regional firms see stronger or weaker demand and whether they are willing "
        "to spend on capacity, equipment, or growth.\n",
        (
            "business demand",
            "output",
            "production",
            "investment",
            "orders",
            "expansion",
            "capacity",
            "factory",
            "business confidence",
            "firms",
        ),
        (
            "Manufacturers report weaker new orders and delay investment decisions.",
            "Local firms expand production after stronger demand from households and exporters.",
        ),
    ),
    Topic(
        "Credit, borrowing and debt conditions",
        "News about access to loans, borrowing costs, repayment stress, consumer credit, and debt burdens. "
        "The topic is central for understanding how tighter or looser financial conditions are felt locally.\n",
        (
            "credit",
            "borrowing",
            "debt",
            "loans",
            "repayments",
            "lenders",
            "arrears",
            "refinancing",
            "interest rates",
            "debt burden",
        ),
        (
            "Households say loan repayments have become harder to manage after higher rates.",
            "Small firms report that bank credit is more expensive and harder to secure.",
        ),
    ),
    Topic(
        "Energy, food and administered-price shocks",
        "News about energy bills, food prices, fuel costs, regulated tariffs, and other externally driven price shocks. "
        "These stories often shape public inflation perceptions and can create sharp regional communication risks.\n",
        (
            "energy bills",
            "fuel costs",
            "food prices",
            "utility bills",
            "tariffs",
            "regulated prices",
            "petrol",
            "electricity",
            "gas prices",
            "supermarket bills",
        ),
        (
            "Food and energy bills rise again, putting renewed pressure on household budgets.",
            "Residents react to higher utility tariffs and warn that winter bills will be difficult to afford.",
        ),
    ),
)


@dataclass(frozen=True)
class Settings:
    # cleaning
    text_min_length: int = 200
    text_for_embedding_chars: int | None = None  # whole texts unless a prefix is asked for
    cleaning_date_min: str = "2020-01-01"
    cleaning_date_max: str = "2023-12-31"
    date_max_delta_days: int = 365
    top_region_rows: int = 15
    example_rows: int = 10
    preview_chars: int = 220
    # candidate rules
    strong_keywords: tuple[str, ...] = STRONG_KEYWORDS
    weak_keywords: tuple[str, ...] = WEAK_KEYWORDS
    url_terms: tuple[str, ...] = URL_TERMS
    # samples
    review_sample_per_stratum: int = 20
    random_state: int = 42
    run_mode: str = "full"  # "dev" scores a sample of at most embedding_story_cap stories
    embedding_story_cap: int = 120_000
    embedding_strong_share: float = 0.70
    # reference texts
    positive_anchors: tuple[str, ...] = POSITIVE_ANCHORS
    negative_anchors: tuple[str, ...] = NEGATIVE_ANCHORS
    topics: tuple[Topic, ...] = TOPICS
    # gate and topic rules
    econ_min_similarity: float = 0.50
    econ_margin_threshold: float = 0.06
    econ_strong_min_similarity: float = 0.47
    econ_strong_margin_threshold: float = 0.03
    econ_negative_guard: float = 0.02
    topic_min_similarity: float = 0.50
    topic_ambiguous_margin: float = 0.02
    # risk index
    prior_strength: float = 20.0
    support_k: float = 5.0
    zscore_clip: float = 3.0
    weight_surprise: float = 0.50
    weight_momentum: float = 0.30
    weight_similarity: float = 0.20
    baseline_window: int = 8
    baseline_min_rows: int = 3
    recent_window: int = 4
    recent_min_rows: int = 2
    prior_mode: str = "per_panel_row"  # or "per_region_week", the share without the topic-count factor
    # outputs
    hot_pairs_top_n: int = 25
    preferred_years: tuple[int, ...] = (2022, 2021)
    recent_weeks: int = 4
    trend_weeks: int = 12
    trend_regions: int = 5
    map_regions: int = 8
    month_year: int = 2022
    month: int = 12
    snippets_per_pair: int = 3
    snippet_chars: int = 220
    snippet_min_chars: int = 40
    boilerplate_patterns: tuple[str, ...] = BOILERPLATE_PATTERNS

    def __post_init__(self):
        if self.run_mode not in ("dev", "full"):
            raise ValueError(f"run_mode must be 'dev' or 'full', not {self.run_mode!r}")
        if self.prior_mode not in ("per_panel_row", "per_region_week"):
            raise ValueError(f"unknown prior_mode {self.prior_mode!r}")

    @property
    def topic_names(self) -> list[str]:
        return [topic.name for topic in self.topics]

    @property
    def panel_topics(self) -> list[str]:
        return [*self.topic_names, OTHER_TOPIC]

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)


def _read_mapping(path: str | Path) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("PyYAML is needed to read YAML settings; use JSON instead") from error
    return yaml.safe_load(text)


def _plain(value):
    return tuple(value) if isinstance(value, list) else value


def load_settings(settings_path: str | Path, topics_path: str | Path | None = None) -> Settings:
    """Read a settings file (sections runtime, filters, profiles, risk) and a topic file.

    Sections are flattened; keys that are no field of `Settings` are ignored.
    """
    raw = _read_mapping(settings_path)
    flat: dict = {}
    for section in ("runtime", "filters", "risk"):
        flat.update(raw.get(section) or {})
    profiles = raw.get("profiles") or {}
    risk_weights = flat.pop("weights", None) or {}
    renamed = {
        "positive_anchors": profiles.get("econ_positive_anchors"),
        "negative_anchors": profiles.get("econ_negative_anchors"),
        "weight_surprise": risk_weights.get("surprise_z"),
        "weight_momentum": risk_weights.get("momentum_z"),
        "weight_similarity": risk_weights.get("mean_similarity_z"),
    }
    flat.update({key: value for key, value in renamed.items() if value is not None})
    if topics_path is not None:
        flat["topics"] = load_topics(topics_path)
    known = {item.name for item in fields(Settings)}
    return Settings(**{key: _plain(value) for key, value in flat.items() if key in known})


def load_topics(path: str | Path) -> tuple[Topic, ...]:
    return tuple(
        Topic(
            entry["name"],
            entry.get("description", ""),
            tuple(entry.get("keywords") or ()),
            tuple(entry.get("seed_examples") or ()),
        )
        for entry in _read_mapping(path)["topics"]
    )
