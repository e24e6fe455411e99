"""Column functions on text: cleaning, tokens, lemmas, morphemes, names, times."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the word counter: patterns, irregular forms, stopwords, clitics and affixes.
TOKEN = r"[a-z0-9]+(?:'[a-z0-9]+)*"
MARKUP = (
    (r"```[\s\S]*?```", "\n"),
    (r"`[^`]*`", " "),
    (r"!\[[^\]]*\]\([^\)]+\)", " "),
    (r"\[([^\]]+)\]\([^\)]+\)", "$1"),
    (r"<[^>]+>", " "),
)
IRREGULAR = {
    "went": "go", "gone": "go", "better": "good", "best": "good", "worse": "bad", "worst": "bad", "did": "do", "done": "do", "had": "have", "has": "have", "does": "do",
    "aren't": "be", "isn't": "be", "was": "be", "were": "be", "been": "be", "am": "be", "i'm": "be", "you're": "be", "we're": "be", "they're": "be", "it's": "it",
    "don't": "do", "can't": "can", "won't": "will",
}
STOPWORDS = tuple("""
    a about above after again against all am an and any are aren't as at be because been before being below between both but by can't cannot could
    couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's
    her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't
    my myself no nor not of off on once only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some
    such than that that's the their theirs them themselves then there there's these they they'd they'll they're they've this those through to too under until up
    very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's with won't would
    wouldn't you you'd you'll you're you've your yours yourself yourselves
""".split())
CLITICS = ("n't", "'re", "'ve", "'ll", "'d", "'m", "'s")
PREFIXES = tuple("""
    anti auto bi co contra counter de dis em en ex extra hetero homo hyper il im in inter intra ir macro micro mid mini mis mono multi non over
    pan post pre proto pseudo re semi sub super tele thermo trans tri ultra un under uni pro
""".split())
SUFFIXES = tuple("""
    ization ational fulness ousness iveness tional biliti lessli entli ation alism aliti ousli iviti fulli enci anci izer ator ally ably less ment ship
    hood dom tion sion xion ingly edly ing ings ed er est able ible ism ist ity ive ous ize ise ness al en y ward wise s es
""".split())


def apply_rules(text: Column, rules) -> Column:
    """Ordered pattern rules, each on what the one before left."""
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def strip_markup(text: Column) -> Column:
    """Code fences, inline code, images, links (their text stays), tags; in this order. Only texts with a mark of these meet the patterns."""
    marked = F.contains(text, F.lit("`")) | F.contains(text, F.lit("[")) | F.contains(text, F.lit("<"))
    return F.when(marked, apply_rules(text, MARKUP)).otherwise(text)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.lower(text), "-_", "  "), F.lit(TOKEN), F.lit(0))


def lemma(word: Column) -> Column:
    """An irregular form, else the first ending that fits: ies (not eies), (s|x|z)es, s (not ss), ied, ed, ing, behind which a doubled letter is undone."""
    n = F.char_length(word)
    cut = lambda k, to="": F.concat(F.left(word, n - k), F.lit(to))
    stem = cut(3)
    rules = (
        F.when((n > 4) & word.rlike("(?<!e)ies$"), cut(3, "y"))
        .when((n > 3) & word.rlike("[sxz]es$"), cut(2))
        .when((n > 2) & word.rlike("(?<!s)s$"), cut(1))
        .when((n > 4) & word.endswith("ied"), cut(3, "y"))
        .when((n > 3) & word.endswith("ed"), cut(2))
        .when((n > 4) & word.endswith("ing"), F.when((n > 6) & stem.rlike(r"(.)\1$"), cut(4)).otherwise(stem))
        .otherwise(word)
    )
    return F.coalesce(F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])[word], rules)


def longest_first(affixes) -> str:
    return "|".join(sorted(affixes, key=lambda x: (-len(x), x)))


def morphemes(word: Column) -> Column:
    """A clitic behind two letters or more; one longest prefix and longest suffixes again and again, each leaving three letters or
    more; scraps of one letter but i and a are dropped, unless nothing else is left."""
    with_clitic = "^(.{2,})(" + "|".join(CLITICS) + ")$"
    head = f"^({longest_first(PREFIXES)})(.{{3,}})$"
    tail = f"^(.{{3,}}?)({longest_first(SUFFIXES)})$"
    clitic = F.regexp_extract(word, with_clitic, 2)
    bare = F.when(clitic != "", F.regexp_extract(word, with_clitic, 1)).otherwise(word)
    prefix = F.regexp_extract(bare, head, 1)
    rest = F.when(prefix != "", F.regexp_extract(bare, head, 2)).otherwise(bare)

    def peel(state: Column, _: Column) -> Column:
        root = F.regexp_extract(state["root"], tail, 1)
        found = F.struct(root.alias("root"), F.concat(F.array(F.regexp_extract(state["root"], tail, 2)), state["ends"]).alias("ends"), F.lit(False).alias("done"))
        ended = F.struct(state["root"].alias("root"), state["ends"].alias("ends"), F.lit(True).alias("done"))
        return F.when(state["done"], state).when(root == "", ended).otherwise(found)

    start = F.struct(rest.alias("root"), F.array().cast("array<string>").alias("ends"), F.lit(False).alias("done"))
    end = F.aggregate(F.sequence(F.lit(1), F.greatest(F.char_length(rest), F.lit(1))), start, peel)  # each ending has a letter or more
    parts = F.concat(F.array(prefix), F.array(end["root"]), end["ends"], F.array(clitic))
    kept = F.filter(parts, lambda p: (F.char_length(p) > 1) | p.isin("i", "a"))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(word))


def term_counts(df: DataFrame, text: str, kind: str = "word", strip: bool = True) -> DataFrame:
    """term, count, is_stopword of words, lemmas or morphemes; words are counted before they are taken apart."""
    body = strip_markup(F.col(text)) if strip else F.col(text)
    words = df.select(F.explode(tokens(body)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("count"))
    if kind == "lemma":
        words = words.select(lemma(F.col("term")).alias("term"), "count").groupBy("term").agg(F.sum("count").alias("count"))
    elif kind == "morpheme":
        words = words.select(F.explode(morphemes(F.col("term"))).alias("term"), "count").groupBy("term").agg(F.sum("count").alias("count"))
    return words.withColumn("is_stopword", F.col("term").isin(*STOPWORDS))


def normalise_corpus(text: Column) -> Column:
    """Lower case, one kind of quote, punctuation set apart or dropped, digits to spaces."""
    out = F.translate(F.lower(text), "’′‘`“”«»", "''''\"\"\"\"")
    out = F.regexp_replace(out, r"([.,()!?;/:])", " $1 ")
    return F.regexp_replace(F.translate(out, '"*_|-', "     "), r"[0-9]", " ")


# What is taken out of wiki pages, in this order.
WIKI = (
    (r"<[^>\n]*>", ""),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    (r"<ref[^<]*</ref>", ""),
    (r"<[^>]*>", ""),
    (r"\[http:[^\] ]*", "["),
    (r"(?i)\|thumb", ""),
    (r"(?i)\|left", ""),
    (r"(?i)\|right", ""),
    (r"(?i)\|\d+px", ""),
    (r"(?i)\[\[image:[^\[\]]*\|", ""),
    (r"(?i)\[\[category:([^|\]]*)[^\]]*\]\]", "[[$1]]"),
    (r"\[\[[a-z\-]*:[^\]]*\]\]", ""),
    (r"\[\[[^|\]]*\|", "[["),
    (r"\{\{[^}]*\}\}", ""),
    (r"\{[^}]*\}", ""),
    (r"\[", ""),
    (r"\]", ""),
    (r"&[^;]*;", " "),
)
# What is taken out of a feed of tickets, in this order.
TICKET = (
    (r"<.*?>", ""),
    (r"Changed [^\.]*from [^\.]*to .*?\.", ""),
    (r"Added .*?\.", ""),
    (r"Assigned [^\.]*to .*?\.", ""),
    (r"Reassigned [^\.]*from [^\.]*to .*?\.", ""),
    (r"Merged .*?\)[:\.]", ""),
    (r"\[Merged from .*?\]", ""),
    (r"Took primary responsibility .*?\.", ""),
    (r"Posted By: .*?>", ""),
    (r"This message was proxied .*>\.", ""),
    (r"\[Created from .*?\]", ""),
    (r"(\\r\\n|\\r|\\n)+", " "),
    (r"(\s|\t)+", " "),
    ("&#39;", "'"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&amp;", "&"),
)


def strip_wiki(text: Column) -> Column:
    return apply_rules(text, WIKI)


def clean_ticket(text: Column) -> Column:
    return apply_rules(text, TICKET)


def html_text(html: Column) -> Column:
    """Scripts and styles dropped, tags to spaces, common entities resolved, spaces collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for entity, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(to))
    return F.trim(F.regexp_replace(F.translate(out, " ", " "), r"[ \t\r\n]+", " "))


def replace_by_key(df: DataFrame, text: str, key: list[str], rules: dict[tuple, list[tuple[str, str]]]) -> DataFrame:
    """Literal replacements that depend on the value of some columns."""
    out = F.col(text)
    for values, pairs in rules.items():
        new = F.col(text)
        for a, b in pairs:
            new = F.replace(new, F.lit(a), F.lit(b))
        cond = F.lit(True)
        for c, v in zip(key, values, strict=True):
            cond = cond & (F.col(c) == v)
        out = F.when(cond, new).otherwise(out)
    return df.withColumn(text, out)


def category(df: DataFrame, col: str, lookup: DataFrame, default: str = "Unknown") -> DataFrame:
    """lookup: value, category."""
    found = lookup.select(F.col("value").alias("_value"), "category")
    return df.join(found, F.col(col) == F.col("_value"), "left").drop("_value").withColumn("category", F.coalesce("category", F.lit(default)))


@dataclass(frozen=True)
class FileRules:
    """What tells where a file goes, given by the caller: endings by bucket, endings of data, of code, of books and of notes, words in names of
    work and of reading, and words by domain. The first that holds counts."""

    buckets: dict[str, tuple[str, ...]]
    data: tuple[str, ...]
    code: tuple[str, ...]
    books: tuple[str, ...]
    notes: tuple[str, ...]
    work: tuple[str, ...]
    reading: tuple[str, ...]
    domains: dict[str, tuple[str, ...]]


def file_place(path: Column, rules: FileRules) -> Column:
    """Where a file goes: a bucket by its ending; else Reading or Work; else Data or Work with a domain by a word in its name; else null."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    ending = F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(name, w))
    domain = F.lit(None).cast("string")
    for kind, words in reversed(rules.domains.items()):
        domain = F.when(has(words), kind).otherwise(domain)
    place = F.when(domain.isNotNull(), F.concat(F.when(ending.isin(*rules.data), "Data/").otherwise("Work/"), domain))
    work = has(rules.work) | ending.isin(*rules.code)
    reading = (ending.isin(*rules.books) & ~has(rules.work)) | (ending.isin(*rules.notes) & has(rules.reading))
    place = F.when(reading, "Reading").when(work, "Work").otherwise(place)
    for bucket, endings in rules.buckets.items():
        place = F.when(ending.isin(*endings), bucket).otherwise(place)
    return place


def name_prefix(name: Column, style: str = "_", segments: int = 1) -> Column:
    """The first segment of a name, or the first two: before ``_``; before ``.`` and then the first word in CamelCase; or CamelCase words.
    Empty if the name has no such segments."""
    pattern = {
        ("_", 1): "^([^_]+)", (".", 1): r"^([^.]+)", ("camel", 1): "^([A-Z]?[a-z0-9]+)",
        ("_", 2): "^([^_]+(?:_[^_]*)?)", (".", 2): r"^([^.]+\.[A-Z][^A-Z.]*)", ("camel", 2): "^([A-Z]?[a-z0-9]+(?:[A-Z][a-z0-9]*)?)",
    }[style, segments]
    return F.regexp_extract(name, pattern, 1)


def strip_sql_comments(sql: Column) -> Column:
    return F.regexp_replace(sql, r"(--[^\n]*(\n|$))|((?s)/\*.*?\*/)", " ")


# What marks a cell as SQL.
SQL_MAGIC = r"(?i)^(%%sql|%%tsql|%%mssql|%sql|%tsql|%mssql|#!sql(?:[-_]\S+)?|#!tsql(?:[-_]\S+)?|#!mssql(?:[-_]\S+)?)\b"
CONNECT_MAGIC = r"(?i)^#!connect\s+(?:mssql|sql|sqlserver)\b"
SQL_FIRST = r"(?i)^(?:;\s*)?(select|with|insert|update|delete|merge|create|alter|drop|truncate|exec(?:ute)?|declare|use|begin|if|while|set|grant|revoke|deny|backup|restore|dbcc|commit|rollback)\b"


def sql_magic(source: Column) -> Column:
    """Whether the first line that isn't blank is a magic for SQL."""
    first_line = F.regexp_extract(F.regexp_replace(source, r"^\s+", ""), r"^([^\r\n]*)", 1)
    return first_line.rlike(SQL_MAGIC) | first_line.rlike(CONNECT_MAGIC)


def looks_like_sql(source: Column) -> Column:
    """A magic line first; or, behind leading comments, a word that begins a statement, a line with GO, or a select with a from."""
    body = F.regexp_replace(source, r"^\s+", "")
    code = F.regexp_replace(body, r"^(?:\s+|--[^\n]*(?:\n|$)|/\*(?s:.*?)\*/)+", "")
    statement = code.rlike(SQL_FIRST) | code.rlike(r"(?im)^\s*go\s*$") | (code.rlike(r"(?i)\bselect\b") & code.rlike(r"(?i)\bfrom\b"))
    return sql_magic(source) | ((code != "") & statement)


def sid_text(sid: Column) -> Column:
    """Bytes of a Windows SID as ``S-revision-authority-parts``; the authority is big-endian, parts little-endian."""
    byte = lambda i, n: F.conv(F.hex(F.substring(sid, i, n)), 16, 10)
    parts = F.transform(
        F.sequence(F.lit(0), ((F.octet_length(sid) - 12) / 4).cast("int")),
        lambda k: F.conv(F.concat(*[F.hex(F.substr(sid, (k * 4 + 12 - j).cast("int"), F.lit(1))) for j in range(4)]), 16, 10),
    )
    return F.concat(F.lit("S-"), byte(1, 1), F.lit("-"), byte(3, 6), F.lit("-"), F.array_join(parts, "-"))


def hhmmss_seconds(x: Column) -> Column:
    return F.floor(x / 10000) * 3600 + F.floor(x / 100) % 100 * 60 + x % 100


def day_and_time(day: Column, time: Column) -> Column:
    """A timestamp from yyyymmdd and hhmmss numbers."""
    return F.to_timestamp(F.concat(day.cast("string"), F.lpad(time.cast("string"), 6, "0")), "yyyyMMddHHmmss")


def time_window(name: str, now: Column) -> tuple[Column, Column]:
    """Begin and end of Today, ThisWeek (from Sunday), ThisMonth, ThisHour, FourHours, or Centered, Forward or
    Backward with an amount and a unit, as in ``Backward 3 day``."""
    step = lambda n, unit: F.expr(f"interval {n} {unit}")
    day = F.date_trunc("day", now)
    sunday = F.timestamp_add("DAY", 1 - F.dayofweek(now), day)
    fixed = {
        "Today": (day, day + step(1, "day")), "ThisWeek": (sunday, sunday + step(7, "day")), "ThisHour": (F.date_trunc("hour", now), F.date_trunc("hour", now) + step(1, "hour")),
        "ThisMonth": (F.date_trunc("month", now), F.add_months(F.date_trunc("month", now), 1).cast("timestamp")), "FourHours": (now - step(2, "hour"), now + step(2, "hour")),
    }
    if name in fixed:
        return fixed[name]
    kind, amount, unit = name.split()
    back, on = {"Centered": (1, 1), "Forward": (0, 1), "Backward": (1, 0)}[kind]
    n = int(amount)
    return now - step(back * n, unit), now + step(on * n, unit)


def boundary_diff(unit: str, a: Column, b: Column) -> Column:
    """Boundaries of the unit crossed between two times."""
    seconds = {"hour": 3600, "minute": 60}[unit]
    return ((F.unix_timestamp(F.date_trunc(unit, b)) - F.unix_timestamp(F.date_trunc(unit, a))) / seconds).cast("long")


def schedule_time(verified: Column, modified: Column, hours: Column) -> Column:
    """The day of ``verified`` at the time of ``modified``, plus hours; 1900-01-01 for what is null."""
    zero = F.lit("1900-01-01 00:00:00").cast("timestamp")
    day, time = F.date_trunc("day", F.coalesce(verified, zero)), F.coalesce(modified, zero)
    seconds = F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time) + F.coalesce(hours, F.lit(0)) * 3600
    return F.timestamp_seconds(F.unix_timestamp(day) + seconds)


def date_label(ts: Column) -> Column:
    return F.date_format(ts, "EEE, yyyy-MM-dd")


def clock_label(ts: Column) -> Column:
    """HH:MM without a leading zero."""
    return F.concat(F.hour(ts).cast("string"), F.lit(":"), F.lpad(F.minute(ts).cast("string"), 2, "0"))


def date_parts(ts: Column) -> dict[str, Column]:
    return {
        "ymd": F.date_format(ts, "yyyy-MM-dd"), "year": F.year(ts), "month2": F.date_format(ts, "MM"), "day2": F.date_format(ts, "dd"),
        "weekday": F.concat(F.dayofweek(ts).cast("string"), F.lit("-"), F.date_format(ts, "EEEE")),
    }


def status_label(status: Column, verified: Column, numrows: Column, last_status: Column) -> Column:
    tail = F.when(verified.isNull() & last_status.isNull(), "new").when(numrows == 0, "empty").when(verified.isNotNull(), "verified").otherwise(last_status)
    return F.concat(status, F.lit("-"), tail)


def is_uuid(text: Column) -> Column:
    return text.rlike(r"(?i)^\{?[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}\}?$")


def front_matter(text: Column) -> dict[str, Column]:
    """title and date from the head, else the title from the first heading."""
    head = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---", 1)
    pick = lambda k: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{k}:\s*[\"']?(.*?)[\"']?\s*$", 1)), F.lit(""))
    return {"title": F.coalesce(pick("title"), F.nullif(F.regexp_extract(text, r"(?m)^#\s+(.+?)\s*$", 1), F.lit(""))), "date": pick("date")}


def labels_of_class(html: Column, name: str, tag: str = "span") -> Column:
    found = F.regexp_extract_all(html, F.lit(rf'(?s)<{tag}[^>]*class="[^"]*\b{name}\b[^"]*"[^>]*>(.*?)</{tag}>'), F.lit(1))
    return F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", ""), r"\s+", " ")))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;?]*[A-Za-z]", "")


def url_base64(data: Column) -> Column:
    return F.translate(F.base64(data), "+/=\r\n", "-_")


def unurl_base64(text: Column) -> Column:
    plain = F.translate(text, "-_", "+/")
    return F.unbase64(F.rpad(plain, F.ceil(F.char_length(plain) / 4).cast("int") * 4, "="))


# Fixed values of the calendar tables: months, the columns where a phase ends, kinds of eclipses, the distance that parts far from near.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
PHASES = ((19, "new"), (37, "first"), (55, "full"), (None, "last"))
SOLAR, LUNAR = {"T": "T", "A": "A", "P": "P", "H": "A"}, {"T": "t", "P": "p", "N": "n"}
FAR = 390_000


def month_number(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int")


def carry_year(df: DataFrame, year: str, order: str, by: list[str]) -> DataFrame:
    """The last year seen before each line that has none."""
    return df.withColumn(year, F.last(year, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order)))


def phase_events(df: DataFrame, line: str, order: str, by: list[str], years: tuple[int, int] = (2001, 2100)) -> DataFrame:
    """``by``, ``order``, year, phase, month, day, time, code of each event in lines of a table of phases: the column an event begins
    in names the phase, the year stands at the head of a line or of one before it."""
    event = rf"({'|'.join(MONTHS)})\s+(\d{{1,2}})\s+(\d{{2}}:\d{{2}})(?:\s+([A-Za-z]))?(?=\s{{2,}}|$)"
    dated = df.select(*by, order, F.rtrim(line).alias("_l")).withColumn("year", F.regexp_extract("_l", r"^\s*(20\d{2}|2100)\b", 1).try_cast("int"))
    dated = carry_year(dated, "year", order, by).where(F.col("year").between(*years))
    parts = dated.withColumns({"_m": F.regexp_extract_all("_l", F.lit(event), F.lit(0)), "_p": F.split("_l", event)}).where(F.size("_m") > 0)
    each = parts.select("*", F.posexplode("_m").alias("_k", "_e"))
    start = F.char_length(F.array_join(F.slice("_p", F.lit(1), F.col("_k") + 1), "")) + F.char_length(F.array_join(F.slice("_m", F.lit(1), F.col("_k")), ""))
    phase = F.lit(PHASES[-1][1])
    for end, name in reversed(PHASES[:-1]):
        phase = F.when(start < end, name).otherwise(phase)
    group = lambda k: F.regexp_extract("_e", event, k)
    return each.select(*by, order, "year", phase.alias("phase"), month_number(group(1)).alias("month"), group(2).cast("int").alias("day"), group(3).alias("time"), group(4).alias("code"))


def eclipse_days(df: DataFrame, key: list[str], text: str, kinds: dict[str, str] = SOLAR) -> DataFrame:
    """``key``, year, month, day, code of the rows of an eclipse table in a text; kinds without a code are left out."""
    row = rf"\b(20\d{{2}}|2100)\s+({'|'.join(MONTHS)})\s+(\d{{2}})\s+(\d{{2}}:\d{{2}}:\d{{2}})\s+\d+\s+\d+\s+\d+\s+([A-Z][A-Za-z0-9+\-]*)\b"
    each = df.select(*key, F.explode(F.regexp_extract_all(text, F.lit(row), F.lit(0))).alias("_r"))
    group = lambda k: F.regexp_extract("_r", row, k)
    code = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.left(group(5), F.lit(1))]
    return each.select(*key, group(1).cast("int").alias("year"), month_number(group(2)).alias("month"), group(3).cast("int").alias("day"), code.alias("code")).where("code is not null")


def distance_rows(df: DataFrame, line: str, order: str, by: list[str], years: tuple[int, int] = (2001, 2100)) -> DataFrame:
    """``by``, ``order``, year, perigee, apogee (each month, day, time, distance, flag, or null) of lines with one or two events."""
    one = rf"(?:({'|'.join(MONTHS)})\s+(\d{{1,2}})\s+(\d{{2}}:\d{{2}})\s+(\d{{6}})(?:\s+([mM])(?=\s|$))?(?:\s+\d+\.\d+(?=\s|$))?)"
    whole = rf"^\s*(?:(\d{{4}})\s+)?{one}(?:\s+{one})?(?:\s|$)"
    timed = df.where(F.col(line).rlike(r"\d{2}:\d{2}")).select(*by, order, F.col(line).alias("_l"), F.regexp_extract(line, r"^\s*(\d{4})(?:\s|$)", 1).try_cast("int").alias("year"))
    dated = carry_year(timed, "year", order, by).where(F.col("year").between(*years)).where(F.col("_l").rlike(whole))
    group = lambda k: F.regexp_extract("_l", whole, k)

    def event(k: int) -> Column:
        made = F.struct(month_number(group(k)).alias("month"), group(k + 1).try_cast("int").alias("day"), group(k + 2).alias("time"), group(k + 3).try_cast("int").alias("distance"), group(k + 4).alias("flag"))
        return F.when(group(k) != "", made)

    both = dated.select(*by, order, "year", F.array(event(7), event(2)).alias("_e"))  # of two alike the second counts
    pick = lambda far: F.try_element_at(F.filter("_e", lambda e: e.isNotNull() & ((e["distance"] >= FAR) == far)), F.lit(1))
    return both.select(*by, order, "year", pick(False).alias("perigee"), pick(True).alias("apogee"))


def override_code(df: DataFrame, key: str, code: str, overrides: DataFrame) -> DataFrame:
    """A listed code wins; else the first letter, H read as A. overrides: key, code."""
    found = overrides.select(F.col("key").alias("_key"), F.col("code").alias("_code"))
    first = F.upper(F.substring(code, 1, 1))
    return df.join(found, F.col(key) == F.col("_key"), "left").withColumn(code, F.coalesce("_code", F.when(first == "H", "A").otherwise(first))).drop("_key", "_code")


def sql_targets(df: DataFrame, key: str, sql: str) -> DataFrame:
    """key, mode, target: names that SQL text reads (after FROM, JOIN, EXEC) or writes (after INTO, UPDATE)."""
    body = strip_sql_comments(F.col(sql))
    pick = lambda words: F.regexp_extract_all(body, F.lit(rf"(?i)\b(?:{words})\s+([^@#\s;(),][^\s;(),]*)"), F.lit(1))
    both = F.concat(F.transform(pick("FROM|JOIN|EXEC"), lambda t: F.struct(F.lit("read").alias("mode"), t.alias("target"))), F.transform(pick("INTO|UPDATE"), lambda t: F.struct(F.lit("write").alias("mode"), t.alias("target"))))
    return df.select(key, F.explode(both).alias("x")).select(key, "x.mode", "x.target").distinct()


def scaled(value: Column, factor: float) -> Column:
    """A text or number times the factor, towards zero to a whole number; null if it is no number."""
    return (value.try_cast("double") * factor).cast("long")


def drawn_items(key: Column, pool: list[str], seed: int = 1, most: int = 3) -> Column:
    """One to ``most`` distinct items of a pool as text, the same for the same key: the order of the pool and how many are drawn by MD5."""
    hashed = lambda *parts: F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), *map(F.lit, parts)))
    ranked = F.transform(F.array_sort(F.array(*[F.struct(hashed(x).alias("h"), F.lit(x).alias("v")) for x in pool])), lambda s: s["v"])
    return F.array_join(F.slice(ranked, F.lit(1), (F.conv(F.substring(hashed(), 1, 8), 16, 10).cast("long") % most).cast("int") + 1), ", ")
