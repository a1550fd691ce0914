"""Rules over short texts as column functions: question types, dates in words, emotions, roles, domains, guards, facts, chunks.

All take a text column and treat null as empty unless said otherwise. Lists marked as fixed values must stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import half_up
from .text import normal

#: Question types, each with the patterns that name it, in the order in which they are tried; "dated" stands for a date in words.
LADDER = (
    ("temporal", r"\b(when did|when was|what happened (?:on|in|during|before|after)|timeline|sequence|history of|over the past|between .* and|from .* to|at what time|how long ago|since when)\b"),
    ("temporal", r"\b(how ha(?:s|ve) .* changed|used to|originally|evolution of|progression|over time|changed (?:from|since|to)|shift(?:ed|ing)|transition(?:ed)?)\b"),
    ("temporal", "dated"),
    ("fact_recall", r"\b(recently|attended|joined|last time|went to|visited|started|stopped|what happened first|what happened after)\b"),
    ("fact_recall", r"\b(what (?:is|are|was|were) (?:my|the|their)|tell me about|do (?:i|they) (?:have|own|use)|what did (?:i|they)|where (?:do|did|does)|who (?:is|was|did))\b"),
    ("reasoning", r"\b(why did|what made|decided|reasons?|because|why do|why does|motivation|what led)\b"),
    ("generalization", r"\b(should i|do you think|considering|would i|could i|is it .* for me|does it make sense for me|good fit|worth it)\b"),
    ("preference", r"\b(suggest|recommend|what would|ideas|what .* try|what .* explore|weekend|fit me|aligned)\b"),
    ("preference", r"\b(favorite|prefer|like most|enjoy|love|hate|dislike|interested in|passionate about|into)\b"),
    ("preference", r"\b(what (?:kind|type|sort) of|taste in|style of|based on (?:my|what))\b"),
)
#: Patterns that add to the score of a question type.
SIGNS = (
    ("temporal", 0.6, r"\b(when did|when was|what happened (?:on|in|during|before|after)|timeline|history of)\b"),
    ("temporal", 0.4, r"\b(over the past|how long ago|since when|from .* to|between .* and|at what time)\b"),
    ("temporal", 0.5, r"\b(how ha(?:s|ve) .* changed|used to|originally|evolution of|over time|progression|shift(?:ed|ing)|transition(?:ed)?)\b"),
    ("temporal", 0.3, "dated"),
    ("fact_recall", 0.5, r"\b(recently|attended|joined|last time|went to|visited|started|stopped)\b"),
    ("fact_recall", 0.5, r"\b(what (?:is|are|was|were) (?:my|the|their)|tell me about|do (?:i|they) (?:have|own|use))\b"),
    ("fact_recall", 0.4, r"\b(what did (?:i|they)|where (?:do|did|does)|who (?:is|was|did))\b"),
    ("reasoning", 0.6, r"\b(why did|what made|decided|reasons?|because|why do|why does)\b"),
    ("reasoning", 0.4, r"\b(motivation|what led|trade.?off|tradeoff)\b"),
    ("generalization", 0.6, r"\b(should i|do you think|considering|would i|could i|good fit|worth it)\b"),
    ("generalization", 0.4, r"\b(does it make sense|is it .* for me|aligned with|make sense for me)\b"),
    ("preference", 0.5, r"\b(suggest|recommend|what would|ideas|what .* try|what .* explore|weekend|fit me)\b"),
    ("preference", 0.6, r"\b(favorite|prefer|like most|enjoy|love|hate|dislike|interested in|passionate about|into)\b"),
    ("preference", 0.4, r"\b(what (?:kind|type|sort) of|taste in|style of|based on (?:my|what))\b"),
)
#: Words that a dated question holds.
ASKING = r"\b(what|who|how|which|did)\b"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
#: Fixed values: (words, emotion, valence, arousal), tried in this order.
EMOTIONS = (
    ("furious|enraged|livid|outraged", "anger", -0.9, 0.9),
    ("angry|pissed|mad|frustrated|annoyed|irritated", "anger", -0.7, 0.7),
    ("terrified|panicked|horrified", "fear", -0.8, 0.9),
    ("anxious|worried|nervous|stressed|afraid|scared", "fear", -0.6, 0.6),
    ("devastated|heartbroken|grief|mourning", "sadness", -0.9, 0.3),
    ("sad|disappointed|depressed|miserable|upset|bummed", "sadness", -0.6, 0.3),
    ("bored|tired|exhausted|drained|burned out|burnt out", "fatigue", -0.3, 0.1),
    ("confused|lost|stuck|puzzled|stumped", "confusion", -0.3, 0.4),
    ("crashed|broken|failed|down|error|bug|issue|problem", "frustration", -0.5, 0.6),
    ("hate|worst|terrible|awful|horrible|garbage|trash", "disgust", -0.8, 0.5),
    ("ecstatic|thrilled|elated|overjoyed", "joy", 0.9, 0.9),
    ("excited|pumped|stoked|hyped|amazing|incredible", "excitement", 0.8, 0.8),
    ("happy|glad|pleased|delighted|great|awesome|fantastic", "joy", 0.7, 0.6),
    ("proud|accomplished|nailed|crushed it|killed it", "pride", 0.7, 0.6),
    ("satisfied|content|good|nice|fine|pleasant|comfortable", "satisfaction", 0.4, 0.3),
    ("calm|relaxed|peaceful|serene|chill", "calm", 0.3, 0.1),
    ("grateful|thankful|appreciate", "gratitude", 0.6, 0.3),
    ("curious|interested|intrigued|fascinated", "curiosity", 0.4, 0.5),
    ("fixed|resolved|working|deployed|shipped|launched|completed|done|finished", "accomplishment", 0.5, 0.5),
    ("love|perfect|beautiful|elegant|clean|brilliant", "admiration", 0.7, 0.4),
    ("surprised|unexpected|wow|whoa", "surprise", 0.0, 0.7),
)
#: The part that an event plays in a chain, by its words.
ROLES = (
    ("trigger", "deployed|started|created|launched|began|initiated"),
    ("failure", "crashed|failed|broke|error|bug|issue"),
    ("resolution", "fixed|resolved|patched|recovered|restored"),
    ("cause", "caused|triggered|led to|resulted in"),
)
#: The domain of a text, by parts of words.
DOMAINS = (
    ("food", "food|cook|bak|eat|restaurant|meal|recipe|cuisine"),
    ("entertainment", "movie|film|show|series|watch|tv|netflix|stream"),
    ("reading", "book|read|novel|author|library"),
    ("music", "music|song|album|artist|band|listen|concert"),
    ("travel", "travel|trip|visit|vacation|hotel|flight|city|country"),
    ("fitness", "sport|run|jog|gym|exercise|hike|swim|yoga|fitness"),
    ("gaming", "game|play|gaming|console"),
    ("technology", "tech|code|program|software|app|computer"),
    ("gardening", "garden|plant|flower|herb"),
    ("pets", "pet|dog|cat|fish|animal|tank|aquarium"),
    ("art", "art|paint|draw|craft|photo"),
    ("shopping", "shop|buy|store|brand|wear|cloth"),
)
#: Words that forbid.
FORBIDS = r"\bnever\b|\bdo not\b|\bdon't\b|\bcritical\b|\bnot\b.*\ballowed\b|\bno\s+(?:purple|blue|indigo)\b"
#: Words that say nothing about whether a claim is grounded.
STOPWORDS = ("this", "that", "with", "from", "have", "been", "were", "they", "about", "their", "there", "which", "would", "could", "should", "these", "those", "then", "than", "when", "what", "also", "into")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _first(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return reduce(lambda rest, p: F.when(p[0], p[1]).otherwise(rest), reversed(pairs), otherwise)


def query_date(query: Column, today: Column) -> Column:
    """The date that a question names: ISO, month and day, or in words before ``today``; null without one."""
    q = F.lower(_text(query))
    iso = F.regexp_extract(q, r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    named = rf"\b({'|'.join(MONTHS)})\s+(\d{{1,2}})(?:\s*,?\s*(\d{{4}}))?\b"
    month, day, year = (F.regexp_extract(q, named, i) for i in (1, 2, 3))
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month)
    by_name = F.concat(F.when(year == "", F.year(today).cast("string")).otherwise(year), F.lit("-"), F.lpad(number.cast("string"), 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    ago = r"\b(\d+)\s+(day|week|month)s?\s+ago\b"
    n, unit = F.coalesce(F.regexp_extract(q, ago, 1).try_cast("int"), F.lit(0)), F.regexp_extract(q, ago, 2)
    back = F.when(unit == "month", F.add_months(today, -n)).otherwise(F.date_sub(today, n * F.when(unit == "week", 7).otherwise(1)))
    as_text = lambda d: F.date_format(d, "yyyy-MM-dd")
    return _first(
        [(iso != "", iso), (month != "", by_name), (q.rlike(r"\byesterday\b"), as_text(F.date_sub(today, 1))), (q.rlike(r"\blast week\b"), as_text(F.date_sub(today, 7))),
         (q.rlike(r"\blast month\b"), as_text(F.add_months(today, -1))), (q.rlike(r"\btoday\b"), as_text(today)), (unit != "", as_text(back))],
        F.lit(None).cast("string"),
    )


def relative_date(reference: Column, base: Column) -> Column:
    """The date of a phrase such as 'last monday' or 'two weeks ago', seen from ``base``; null for any other."""
    low = F.lower(F.trim(_text(reference)))
    ago = r"^(\w+)\s+(day|week|month)s?\s+ago$"
    word, unit = F.regexp_extract(low, ago, 1), F.regexp_extract(low, ago, 2)
    place = F.array_position(F.array(*[F.lit(w) for w in NUMBERS]), word).cast("int")
    n = F.when(word.isin("a", "an"), 1).when(place > 0, place).otherwise(F.coalesce(F.regexp_extract(word, r"^(\d+)", 1).try_cast("int"), F.lit(0)))
    back = F.when(unit == "month", F.add_months(base, -n)).otherwise(F.date_sub(base, n * F.when(unit == "week", 7).otherwise(1)))
    weekday = F.regexp_extract(low, rf"^last\s+({'|'.join(WEEKDAYS)})$", 1)
    diff = F.dayofweek(base) - F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), weekday).cast("int")
    return _first(
        [(low.isin("today", "this morning", "this afternoon", "this evening"), base), (low.isin("yesterday", "last morning", "last afternoon", "last evening"), F.date_sub(base, 1)),
         ((unit != "") & (n > 0), back), (low.rlike(r"^last\s+week$"), F.date_sub(base, 7)), (low.rlike(r"^last\s+month$"), F.add_months(base, -1)),
         (weekday != "", F.date_sub(base, F.when(diff <= 0, diff + 7).otherwise(diff)))],
        F.lit(None).cast("date"),
    )


def _sign(query: Column, pattern: str, today: Column) -> Column:
    q = F.lower(_text(query))
    return query_date(query, today).isNotNull() & q.rlike(ASKING) if pattern == "dated" else q.rlike(pattern)


def question_type(query: Column, today: Column) -> Column:
    """The first type whose pattern a question matches; fact_recall if none does."""
    return _first([(_sign(query, p, today), F.lit(label)) for label, p in LADDER], F.lit("fact_recall"))


def question_mix(query: Column, today: Column) -> Column:
    """map<type, weight>: each type's share of the signs that a question shows, to two places; fact_recall alone if it shows none."""
    kinds = tuple(dict.fromkeys(k for k, _, _ in SIGNS))
    score = {k: reduce(lambda a, b: a + b, [F.when(_sign(query, p, today), w).otherwise(0.0) for kind, w, p in SIGNS if kind == k]) for k in kinds}
    # inside a lambda the sums are worked out once
    parts = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), score[k].alias("value")) for k in kinds]), lambda x: x["value"] > 0)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x["value"])
    shares = F.map_from_entries(F.transform(parts, lambda x: F.struct(x["key"], half_up(x["value"] / total(parts), 2))))
    return F.when(F.size(parts) == 0, F.create_map(F.lit("fact_recall"), F.lit(1.0))).otherwise(shares)


def emotion(content: Column) -> Column:
    """struct<valence, arousal, dominant>: means of the emotions whose words a text holds, weighted by strength; the strongest, the first of equals."""
    found = F.filter(
        F.array(*[F.when(F.lower(_text(content)).rlike(rf"\b({words})\b"), F.struct(F.lit(name).alias("emotion"), F.lit(v).alias("v"), F.lit(a).alias("a"))) for words, name, v, a in EMOTIONS]), lambda x: x.isNotNull()
    )
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("v"), F.lit(0.0).alias("a"), F.lit(-1.0).alias("most"), F.lit("neutral").alias("dominant"))

    def step(s: Column, x: Column) -> Column:
        w = F.abs(x["v"])
        return F.struct((s["w"] + w).alias("w"), (s["v"] + x["v"] * w).alias("v"), (s["a"] + x["a"] * w).alias("a"), F.greatest(s["most"], w).alias("most"), F.when(w > s["most"], x["emotion"]).otherwise(s["dominant"]).alias("dominant"))

    def done(s: Column) -> Column:
        mean = lambda c: F.when(s["w"] > 0, half_up(s[c] / s["w"], 2)).otherwise(0.0)
        return F.struct(mean("v").alias("valence"), mean("a").alias("arousal"), s["dominant"].alias("dominant"))

    return F.aggregate(found, zero, step, done)


def chain_role(content: Column) -> Column:
    return _first([(F.lower(_text(content)).rlike(rf"\b({words})\b"), F.lit(role)) for role, words in ROLES], F.lit("event"))


def chain_name(content: Column) -> Column:
    """The first three words of more than three letters."""
    name = F.array_join(F.slice(F.filter(F.split(_text(content), r"\s+"), lambda w: F.length(w) > 3), 1, 3), " ")
    return F.when(name == "", "unnamed chain").otherwise(name)


def domain(content: Column) -> Column:
    return _first([(F.lower(_text(content)).rlike(parts), F.lit(name)) for name, parts in DOMAINS], F.lit("general"))


def guard(content: Column, importance: Column, trust: Column | None = None) -> Column:
    """What a rule says of an action: warn if it weighs 10 or forbids, else allow; an agent trusted under 30 is blocked instead of warned."""
    warn = (importance >= 10) | F.lower(_text(content)).rlike(FORBIDS)
    return F.when(warn, "warn" if trust is None else F.when(trust < 30, "block").otherwise("warn")).otherwise("allow")


def ungrounded_claims(answer: Column, corpus: Column) -> Column:
    """The sentences of an answer of whose keywords less than a quarter stand in the corpus."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    claims = F.filter(F.transform(F.split(_text(answer), "[.!?]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 20)

    def loose(claim: Column) -> Column:
        words = F.filter(F.split(F.regexp_replace(F.lower(claim), "[^a-z0-9 ]", " "), r"\s+"), lambda w: (F.length(w) > 4) & ~F.array_contains(stop, w))
        return (F.size(words) > 0) & (F.size(F.filter(words, lambda w: F.contains(corpus, w))) < 0.25 * F.size(words))

    return F.filter(claims, loose)


def sentences(content: Column, least: int = 1) -> Column:
    parts = F.transform(F.split(_text(content), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) >= least)


def match_terms(query: Column) -> Column:
    """The quoted terms of a full-text query, any of which may match."""
    words = F.filter(F.split(F.trim(F.regexp_replace(_text(query), r"[^\w\s-]", " ")), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def clamped_importance(value: Column, default: float = 5.0) -> Column:
    """A number held to 1..10; what is no number is the default, null 1, blank 1."""
    n = F.when(value.isNull(), 0.0).when(F.trim(value) == "", 0.0).otherwise(F.trim(value).try_cast("double"))
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), default).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(10.0), n)))


def rejection(content: Column, most: int = 102_400) -> Column:
    """Why a text can't be stored, null if it can."""
    return F.when(F.trim(_text(content)) == "", "empty").when(F.length(content) > most, "too large")


def correction(text_: Column, claim: Column, memory_id: Column) -> Column:
    was = F.concat(F.lit('[CORRECTION] Was: "'), F.left(claim, F.lit(200)), F.lit('". Correct: '), text_)
    of = F.concat(F.lit("[CORRECTION of #"), memory_id.cast("string"), F.lit("] "), text_)
    return F.when((_text(claim) != "") & (F.coalesce(memory_id, F.lit(0)) != 0), was).when(F.coalesce(memory_id, F.lit(0)) != 0, of).otherwise(text_)


def signal_match(query: str, haystack: Column, subject: Column, intensity: Column) -> Column:
    """How well a signal fits a query: the phrase, the subject, the share of words, and intensity; at most 1."""
    phrase = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split())
    terms = list(dict.fromkeys(t for t in phrase.split() if len(t) >= 3))
    hay = normal(haystack)
    parts = [F.when(F.contains(hay, F.lit(phrase)), 0.45).otherwise(0.0) if phrase else F.lit(0.0)]
    parts.append(F.when(F.exists(F.split(normal(subject), " "), lambda w: (w != "") & F.contains(F.lit(phrase), w)), 0.05).otherwise(0.0))
    if terms:
        hits = reduce(lambda a, b: a + b, [F.contains(hay, F.lit(t)).cast("int") for t in terms])
        parts.append(hits / len(terms) * 0.35)
    parts.append(F.greatest(F.lit(0.0), F.least(F.coalesce(intensity, F.lit(0.0)), F.lit(1.0))) * 0.2)
    return F.when(hay == "", 0.0).otherwise(F.least(F.lit(1.0), reduce(lambda a, b: a + b, parts)))


def scale_tier(n: Column) -> Column:
    return F.when(n < 1_000, "micro").when(n < 10_000, "small").when(n < 50_000, "medium").when(n < 200_000, "large").otherwise("xlarge")


def next_send(schedule: Column, now: Column) -> Column:
    hours = F.when(schedule == "hourly", 1).when(schedule == "weekly", 168).otherwise(24)
    return F.timestamp_seconds(F.unix_timestamp(now) + hours * 3600)


def duration(started: Column, ended: Column) -> Column:
    """Whole seconds, rounded; 0 if an end is missing or they run backwards."""
    s = F.floor((F.unix_micros(ended.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / 1e6 + 0.5)
    return F.greatest(F.lit(0), F.coalesce(s, F.lit(0))).cast("long")


def private_host(host: Column) -> Column:
    """Hosts that a fetch must not reach: this machine, private and link-local networks, internal names."""
    h = F.lower(_text(host))
    v4 = r"^(0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\."
    return (h == "") | h.isin("localhost", "::1", "[::1]") | h.rlike(v4) | h.rlike(r"\.(local|internal|localhost)$") | h.rlike(r"^\[?(fc|fd|fe80)[0-9a-f:]*\]?$")


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with keys in order, which equal contents share; its SHA-256 signs them."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
