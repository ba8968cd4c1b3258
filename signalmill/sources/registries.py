"""Registries of assets, sectors and sources, and reading them from JSON."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..schemas import REGISTRY


@dataclass(frozen=True)
class Entry:
    """One asset or sector that texts can be about."""

    id: int
    symbol: str
    name: str
    identifiers: tuple[str, ...] = ()
    cased: tuple[str, ...] = ()
    cashtags: tuple[str, ...] = field(default=())
    description: str | None = None


# The assets and sectors that labels refer to, with their identifiers.
ASSETS = (
    Entry(1, "BTC", "Bitcoin", ("bitcoin", "btc", "$btc", "satoshi", "lightning network"), (), ("$BTC",)),
    Entry(2, "ETH", "Ethereum", ("ethereum", "eth", "$eth", "vitalik", "solidity", "erc-20", "erc20", "erc-721", "erc721"), (), ("$ETH",)),
    Entry(3, "SOL", "Solana", ("solana",), ("SOL",), ("$SOL",)),
    Entry(4, "TAO", "Bittensor", ("bittensor", "tao", "$tao", "opentensor", "dtao", "bittensor subnet"), (), ("$TAO",)),
)
SECTORS = (
    Entry(1, "CRYPTO", "Crypto & Digital Assets", ("bitcoin", "ethereum", "crypto", "blockchain", "defi", "nft", "stablecoin", "binance", "coinbase", "solana", "bittensor", "cryptocurrency", "digital asset", "web3", "token", "altcoin", "decentralized"), (), ("$BTC", "$ETH", "$SOL", "$TAO", "$XRP", "$ADA", "$DOGE", "$AVAX", "$DOT", "$LINK", "$MATIC")),
    Entry(2, "MONETARY", "Monetary Policy & Central Banks", ("federal reserve", "interest rate", "fomc", "rate cut", "rate hike", "quantitative easing", "quantitative tightening", "central bank", "ecb", "bank of japan", "monetary policy", "inflation target", "fed funds", "treasury yield", "bond yield", "yield curve")),
    Entry(3, "MACRO", "Macro & Economy", ("gdp", "inflation", "unemployment", "trade deficit", "consumer spending", "consumer price index", "cpi", "ppi", "recession", "economic growth", "labor market", "jobs report", "nonfarm payrolls", "retail sales", "housing starts", "economic outlook")),
    Entry(4, "EQUITIES", "Equities & Corporate", ("earnings", "ipo", "nasdaq", "s&p 500", "dow jones", "stock market", "wall street", "quarterly results", "revenue growth", "profit margin", "dividend", "share buyback", "market cap", "stock price")),
    Entry(5, "COMMODITIES", "Commodities & Energy", ("crude oil", "gold price", "natural gas", "opec", "commodity", "silver", "copper", "wheat", "agriculture", "petroleum", "brent crude", "wti", "precious metal", "energy market")),
    Entry(6, "GEOPOLITICS", "Geopolitics & Regulation", ("sanctions", "trade war", "tariff", "regulation", "legislation", "securities and exchange commission", "sec filing", "congress", "executive order", "treaty", "embargo", "diplomatic", "compliance", "antitrust")),
    Entry(7, "TECH", "Technology & AI", ("artificial intelligence", "semiconductor", "cloud computing", "cybersecurity", "machine learning", "neural network", "chip shortage", "gpu", "data center", "quantum computing", "large language model", "generative ai")),
    Entry(8, "SCIENCE", "Science & Health", ("fda approval", "clinical trial", "vaccine", "biotech", "pharmaceutical", "climate change", "research study", "genome", "crispr", "pandemic", "public health", "drug approval", "medical device")),
    Entry(9, "OTHER", "Other"),
)
NO_ASSET, OTHER_SECTOR = Entry(0, "NONE", "None"), SECTORS[-1]

# The credibility of news sources; 0.5 for any other.
SOURCE_CREDIBILITY = {
    "reuters": 1.0,
    "ap_news": 1.0,
    "bbc": 1.0,
    "financial_times": 1.0,
    "wsj": 1.0,
    "bloomberg": 1.0,
    "economist": 0.9,
    "nytimes": 0.9,
    "washington_post": 0.9,
    "cnbc": 0.8,
    "guardian": 0.8,
    "politico": 0.8,
    "npr": 0.8,
    "forbes": 0.8,
    "barrons": 0.8,
    "abc_news": 0.8,
    "cbs_news": 0.8,
    "nbc_news": 0.8,
    "cnn_finance": 0.8,
    "la_times": 0.8,
    "usa_today": 0.8,
    "chicago_tribune": 0.8,
    "the_atlantic": 0.8,
    "techcrunch": 0.7,
    "ars_technica": 0.7,
    "wired": 0.7,
    "marketwatch": 0.7,
    "investopedia": 0.7,
    "nasdaq": 0.7,
    "seeking_alpha": 0.7,
    "yahoo_finance": 0.7,
    "sp_global": 0.7,
    "investing_com": 0.7,
    "business_insider": 0.7,
    "the_hill": 0.7,
    "propublica": 0.7,
    "mit_tech_review": 0.7,
    "vox": 0.7,
    "motley_fool": 0.6,
    "benzinga": 0.6,
    "thestreet": 0.6,
    "zacks": 0.6,
    "zero_hedge": 0.6,
    "engadget": 0.6,
    "gizmodo": 0.6,
    "federal_reserve": 0.9,
    "sec": 0.9,
    "treasury": 0.9,
    "brookings": 0.8,
    "nasa": 0.8,
    "cdc_newsroom": 0.8,
    "al_jazeera": 0.7,
    "france24": 0.7,
    "deutsche_welle": 0.7,
    "scmp": 0.7,
    "nhk_world": 0.7,
    "japan_times": 0.6,
    "the_hindu": 0.6,
    "le_monde": 0.7,
    "der_spiegel": 0.7,
    "kqed": 0.6,
    "nature_news": 0.8,
    "scientific_american": 0.7,
    "new_scientist": 0.7,
    "ieee_spectrum": 0.7,
    "science_daily": 0.6,
    "live_science": 0.6,
    "space_com": 0.6,
    "rolling_stone": 0.5,
    "pitchfork": 0.4,
    "variety": 0.5,
    "hollywood_reporter": 0.5,
    "artforum": 0.4,
    "scotusblog": 0.6,
    "smithsonian": 0.6,
    "inside_climate": 0.6,
    "rt_news": 0.4,
}
DEFAULT_CREDIBILITY = 0.5

# The labels of each dimension.
SENTIMENTS = ("very_bullish", "bullish", "neutral", "bearish", "very_bearish")
CONTENT_TYPES = ("technical_insight", "announcement", "partnership", "milestone", "tutorial", "security", "governance", "market_discussion", "hiring", "meme", "hype", "opinion", "community", "fud", "other")
ARTICLE_CONTENT_TYPES = ("breaking_news", "analysis", "opinion", "earnings", "regulatory", "research", "press_release", "interview", "other")
TECHNICAL_QUALITIES = ("high", "medium", "low", "none")
MARKET_ANALYSES = ("technical", "economic", "political", "social", "other")
IMPACTS = ("HIGH", "MEDIUM", "LOW", "NONE")
CONFIDENCES = ("high", "medium", "low")


def credibility(spark: SparkSession) -> DataFrame:
    """(source, credibility), under a hundred rows."""
    return spark.createDataFrame(list(SOURCE_CREDIBILITY.items()), "source string, credibility double")


def registry_table(spark: SparkSession, path: str) -> DataFrame:
    """A registry of any size from a JSON array, as a table for :func:`matching.all_matches`."""
    return spark.read.schema(REGISTRY).option("multiLine", True).json(path)


def read_registry(spark: SparkSession, path: str) -> tuple[Entry, ...]:
    """Entries of a JSON array, in file order, for expressions; one with very many entries is better kept as a table."""
    rows = registry_table(spark, path).collect()
    return tuple(Entry(r.id, r.symbol, r.name, tuple(r.unique_identifiers or ()), tuple(r.case_sensitive_identifiers or ()), tuple(r.cashtags or ()), r.description) for r in rows)


def as_table(spark: SparkSession, registry: tuple[Entry, ...]) -> DataFrame:
    """Entries as a table, in the schema of a stored registry."""
    return spark.createDataFrame([(e.id, e.symbol, e.name, e.description, list(e.identifiers), list(e.cased), list(e.cashtags), None) for e in registry], REGISTRY)


def with_entry(registry: tuple[Entry, ...], entry: Entry) -> tuple[Entry, ...]:
    """The registry with one more entry, or with that of the same id replaced."""
    return (*(e for e in registry if e.id != entry.id), entry)
