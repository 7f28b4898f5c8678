"""Column expressions that clean raw text tables: numbers, dates, ids, labels, roles."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "__unknown__"

# Text that means "not known yet".
TBD = ["", "nan", "none", "null", "tbd", "unknown", "__unknown__"]

# The role of each agent and how sure it is.
AGENT_ROLES = {
    "jett": ("Duelist", 0.98), "raze": ("Duelist", 0.98), "neon": ("Duelist", 0.98), "phoenix": ("Duelist", 0.98),
    "reyna": ("Duelist", 0.98), "yoru": ("Duelist", 0.98), "iso": ("Duelist", 0.98), "waylay": ("Duelist", 0.95),
    "sova": ("Initiator", 0.98), "breach": ("Initiator", 0.98), "skye": ("Initiator", 0.98), "kayo": ("Initiator", 0.98),
    "fade": ("Initiator", 0.98), "gekko": ("Initiator", 0.98), "tejo": ("Initiator", 0.95),
    "brimstone": ("Controller", 0.98), "omen": ("Controller", 0.98), "viper": ("Controller", 0.98), "astra": ("Controller", 0.98),
    "harbor": ("Controller", 0.95), "clove": ("Controller", 0.95),
    "sage": ("Sentinel", 0.98), "cypher": ("Sentinel", 0.98), "killjoy": ("Sentinel", 0.98), "chamber": ("Sentinel", 0.95),
    "deadlock": ("Sentinel", 0.95), "vyse": ("Sentinel", 0.95),
}
NO_ROLE = ("Flex/Unknown", 0.0)

# What a title says about its region, China first.
REGION_MARKERS = [
    ("CHINA", r"\bchina\b|\bchinese\b"),
    ("EMEA", r"\bemea\b|\beurope\b"),
    ("AMERICAS", r"\bamericas\b|north america|latin america|\blatam\b|\bbrazil\b"),
    ("PACIFIC", r"\bpacific\b|\bjapan\b|\bkorea\b|southeast asia|south asia|\bsea\b|\boceania\b"),
]

TIMESTAMP_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd h:mm a"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and infinities to null."""
    c = _col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def to_number(c: Column | str) -> Column:
    """Text to double; what is no finite number becomes null."""
    return finite(F.trim(_col(c)).try_cast("double"))


def percent(c: Column | str, fraction: bool = True) -> Column:
    """``83%`` to 0.83, or to 83 without ``fraction``."""
    x = to_number(F.replace(F.trim(_col(c)), F.lit("%"), F.lit("")))
    return x / 100 if fraction else x


def ratio(top: Column, bottom: Column) -> Column:
    """Null where the denominator is zero."""
    return top / F.nullif(bottom, F.lit(0).cast("double"))


def match_timestamp(date: Column | str, time: Column | str | None = None) -> Column:
    """Date and time, else the date alone; null if neither parses."""
    date = F.trim(_col(date).cast("string"))
    alone = F.coalesce(F.try_to_timestamp(date, F.lit("yyyy-MM-dd")), date.try_cast("timestamp"))
    if time is None:
        return alone
    both = F.concat_ws(" ", date, F.upper(F.trim(_col(time).cast("string"))))
    return F.coalesce(*[F.try_to_timestamp(both, F.lit(f)) for f in TIMESTAMP_FORMATS], alone)


def calendar(ts: Column | str) -> dict[str, Column]:
    """Year, month and day of the week (Monday 0) as doubles."""
    ts = _col(ts)
    return {"match_year": F.year(ts).cast("double"), "match_month": F.month(ts).cast("double"), "match_dayofweek": F.weekday(ts).cast("double")}


def key_text(c: Column | str) -> Column:
    """Lower case, only letters and digits."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(_col(c).cast("string"), F.lit("")))), "[^a-z0-9]+", "")


def add_roles(df: DataFrame, agent: str = "agent", table: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """Set role and role_confidence from a fixed table; an explicit, non-blank role and a given confidence win."""
    table = AGENT_ROLES if table is None else table
    names = F.create_map(*chain.from_iterable((F.lit(k), F.lit(r)) for k, (r, _) in table.items()))
    sure = F.create_map(*chain.from_iterable((F.lit(k), F.lit(s)) for k, (_, s) in table.items()))
    key = key_text(agent) if agent in df.columns else F.lit("")
    role, confidence = F.coalesce(names[key], F.lit(NO_ROLE[0])), F.coalesce(sure[key], F.lit(NO_ROLE[1]))
    if "role" in df.columns:
        role = F.coalesce(F.when(F.trim("role") != "", F.trim("role")), role)
    if "role_confidence" in df.columns:
        confidence = F.coalesce(F.col("role_confidence").try_cast("double"), confidence)
    return df.withColumns({"role": role, "role_confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))})


def simple_role(agent: Column | str) -> Column:
    """Role without a default; ``veto`` counts as Initiator."""
    pairs = {k: r for k, (r, _) in AGENT_ROLES.items()} | {"veto": "Initiator"}
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(r)) for k, r in pairs.items()))[key_text(agent)]


def stage_importance(stage: Column | str, round_name: Column | str | None = None) -> Column:
    """Weight of a match by the words of its stage and round: groups before playoffs before finals decide, else 0.5."""
    parts = [F.coalesce(_col(c).cast("string"), F.lit("")) for c in (stage, round_name) if c is not None]
    s = F.lower(F.concat_ws(" ", *parts))
    return (
        F.when(s.rlike("group|regular|swiss"), 0.4)
        .when(s.rlike("semi|playoff|upper|lower"), 0.8)
        .when(s.rlike("final|championship"), 1.0)
        .otherwise(0.5)
    )


def known_text(c: Column | str) -> Column:
    """Trimmed text; null where it means unknown."""
    t = F.trim(_col(c).cast("string"))
    return F.when(~F.lower(t).isin(TBD), t)


def semantic_region(title: Column | str) -> Column:
    """Region that a title names, else null."""
    t = F.lower(F.trim(_col(title)))
    first, *rest = REGION_MARKERS
    out = F.when(t.rlike(first[1]), first[0])
    for name, marks in rest:
        out = out.when(t.rlike(marks), name)
    return out


def id_from_url(url: Column | str, kind: str) -> Column:
    """The digits after ``/kind/``, or right after the host for a match."""
    pattern = r"^(?:https?://[^/]+)?/(\d+)(?:/|$)" if kind == "match" else rf"/{kind}/(\d+)(?:/|$)"
    return F.nullif(F.regexp_extract(_col(url), pattern, 1), F.lit(""))


def event_dates(raw: Column | str) -> dict[str, Column]:
    """start_date and end_date of ``jul 15 - jul 20, 2024``; an end of digits only has the start's month."""
    parts = F.split(F.lower(F.trim(_col(raw))), r"\s*[–-]\s*|,\s*")
    start, end, year = (F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")) for i in range(3))
    end = F.when(end.rlike(r"^\d+$"), F.concat_ws(" ", F.split(start, " ")[0], end)).otherwise(end)
    # Months in three letters.
    months = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    number = F.create_map(*chain.from_iterable((F.lit(m), F.lit(f"{i:02d}")) for i, m in enumerate(months, 1)))
    day = lambda d: F.to_date(F.concat(year, F.lit("-"), number[F.substring(d, 1, 3)], F.lit("-"), F.lpad(F.regexp_extract(d, r"(\d+)$", 1), 2, "0")))
    return {"start_date": day(start), "end_date": day(end)}


def winner(ct_rounds: list[Column], t_rounds: list[Column], ct: Column | str, t: Column | str) -> Column:
    """The name with more rounds, or ``Draw``; missing rounds count as none."""
    a, b = (sum((F.coalesce(c, F.lit(0)) for c in x[1:]), F.coalesce(x[0], F.lit(0))) for x in (ct_rounds, t_rounds))
    return F.when(a > b, _col(ct)).when(b > a, _col(t)).otherwise(F.lit("Draw"))


def round_score(ct_rounds: list[Column], t_rounds: list[Column]) -> Column:
    """``CT/T 13-9``."""
    a, b = (sum((F.coalesce(c, F.lit(0)) for c in x[1:]), F.coalesce(x[0], F.lit(0))).cast("double") for x in (ct_rounds, t_rounds))
    whole = (a == F.floor(a)) & (b == F.floor(b))
    return F.when(whole, F.format_string("CT/T %d-%d", a.cast("long"), b.cast("long"))).otherwise(F.format_string("CT/T %.1f-%.1f", a, b))


def search_text(c: Column | str) -> Column:
    """Lower case with single blanks, for ``contains``."""
    return F.lower(F.regexp_replace(F.trim(F.coalesce(_col(c), F.lit(""))), r"\s+", " "))


def experience_bucket(n: Column | str) -> Column:
    """0, 1-5, 6-20 and more maps."""
    n = _col(n)
    return F.when(n <= -1, None).when(n <= 0, "cold_start").when(n <= 5, "1-5").when(n <= 20, "6-20").when(n.isNotNull(), "21+")


def low_confidence(cold: Column | str, sample: Column | str) -> dict[str, Column]:
    low = (F.coalesce(_col(cold), F.lit(0.0)) == 1) | (F.coalesce(_col(sample), F.lit(0.0)) < 5)
    text = F.when(low, "Low confidence: limited player history or cold start").otherwise("Use as estimated performance, not a win probability")
    return {"low_confidence": low, "confidence_warning": text}


def fill_unknown(df: DataFrame, categories: list[str], importance: str = "match_importance") -> DataFrame:
    """Absent and null categories become ``__unknown__``, an absent or null importance 0.5."""
    fill = {c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) if c in df.columns else F.lit(UNKNOWN) for c in categories}
    fill[importance] = F.coalesce(F.col(importance).try_cast("double"), F.lit(0.5)) if importance in df.columns else F.lit(0.5)
    return df.withColumns(fill)


def display_label(name: Column | str, team: Column | str, key: Column | str) -> Column:
    return F.concat(_col(name), F.lit(" ("), F.coalesce(_col(team), F.lit("?")), F.lit(") · id="), _col(key).cast("string"))
