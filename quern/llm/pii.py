"""PII surrogates: detected entities get keyed replacements of their type, gender, script and format. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import materialize

# Forms of entities, as Java regular expressions.
EMAIL = r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
PHONE = r"(?<![\p{L}\p{N}])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\p{L}\p{N}.-])\d{3}-\d{3}-\d{4}(?![\d-])"
SSN = r"(?<![\p{L}\p{N}.-])\d{3}-\d{2}-\d{4}(?![\d-])"
IP = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?[\p{L}\p{N}])"
CARD = r"(?<![\p{L}\p{N}.-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\p{L}\p{N}])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
SECRET = r"(?i:(?<=\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?))(?=[A-Za-z_/+-]*\d)[A-Za-z0-9_/+-]{12,}|\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,})"
FORMS = {"email": EMAIL, "phone": PHONE, "ssn": SSN, "ip": IP, "card": CARD, "iban": IBAN, "secret": SECRET}
ENTITY = "|".join(f"(?:{x})" for x in FORMS.values())
#: What a text must have for any of the forms to occur.
HINT = r"[\d@]"
# Titles by gender; n: either.
TITLES = {"m": "Mr Herr Monsieur Sr Señor г-н господин κύριος".split(), "f": "Mrs Ms Miss Frau Mme Madame Mlle Sra Señora г-жа госпожа κυρία".split(), "n": ["Dr", "Prof"]}
# Titles that follow a Chinese or Japanese name, by gender, and the most common Chinese family names.
SUFFIXES = {"m": ["先生", "氏"], "f": ["女士", "小姐", "太太"], "n": ["さん", "様", "教授", "博士"]}
FAMILY_HAN = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
_WORD = r"\p{Lu}[\p{L}'’-]+"
_TITLES = sum(TITLES.values(), [])
_BEFORE = "|".join([*_TITLES, *(t.upper() for t in _TITLES)])
# All in lower case, a title has one word behind it; a title in any case tells of a name that is known already.
_LOWER = r"(?:mr|mrs|ms)\.? (?!(?:and|or|und|et|y)(?![\p{L}\p{N}]))\p{Ll}[\p{Ll}'’-]+"
TITLED = rf"(?<![\p{{L}}\p{{N}}])(?:(?:(?:{_BEFORE})\.?|M\.) {_WORD}(?: {_WORD})?|{_LOWER})"
_TOLD = rf"(?<=(?<![\p{{L}}\p{{N}}])(?iu:{'|'.join(_TITLES)})\.? (?:[\p{{L}}'’-]{{1,40}} )?)"
_AFTER = "|".join(sum(SUFFIXES.values(), []))
TITLED_HAN = rf"(?:[{FAMILY_HAN}]\p{{IsHan}}{{0,2}}?|(?<!\p{{IsHan}})\p{{IsHan}}{{1,4}}?)(?:{_AFTER})"
# Syllables and endings of made-up names by script, characters of given names by gender, letters by script.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi fo ga ge gi go ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi vo za zo".split(),
    "cyrillic": "ба бе би бо да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то".split(),
    "greek": "βα βε βι βο δα δε δι δο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σι σο τα τε τι το".split(),
}
ENDINGS = {("latin", "m"): "n r s k l m".split(), ("latin", "f"): "a ia na la ra".split(), ("cyrillic", "m"): "н р к л м".split(), ("cyrillic", "f"): "а ия на ла".split(), ("greek", "m"): "ς ρος νος λης".split(), ("greek", "f"): "α ια νη λα".split()}
GIVEN_HAN = {"m": "伟强军勇磊涛明超刚辉鹏斌", "f": "芳娜敏静丽娟艳霞玲婷雪慧"}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
#: Characters of scripts without case that give way to others of the script: Han, Hiragana, Katakana, Hangul.
CASELESS = {"Han": "天地山水火木土石田日月星云雨风雪花草林海河江湖泉", "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねの", "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノ", "Hangul": "가나다라마바사아자차카타파하고노도로모보소오조초"}
_HEX = "abcdef"
#: From this attempt on, surrogates grow by some characters, so there is always one left.
GROWS = 4
#: The entities of so many texts, of so many characters with their surrogates, are broadcast: 64 MB at most; beyond it, they meet the texts by a shuffle.
BROADCAST_TEXTS, BROADCAST_CHARS = 200_000, 16_000_000


def luhn(number: Column) -> Column:
    """The sum of the Luhn check over the digits of a number; 0 modulo 10 if they are valid."""
    digits = F.reverse(F.filter(F.split(number, ""), lambda c: c.rlike(r"^\d$")))
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(digits, lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x)


def kind_of(entity: Column) -> Column:
    """The type of an entity that ENTITY has found; null for numbers like those of cards that fail the Luhn check."""
    whole = lambda x: entity.rlike(rf"^(?:{x})$")
    digits = F.length(F.regexp_replace(entity, r"\D", ""))
    kind = F.when(entity.contains("@"), "email").when(whole(r"(?:\d{1,3}\.){3}\d{1,3}"), "ip")
    kind = kind.when(whole(r"\d{3}-\d{2}-\d{4}"), "ssn").when(whole(r"\+\d[\d ().-]*|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}"), "phone")
    kind = kind.when(whole(r"[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}"), F.when((luhn(entity) % 10 == 0) & digits.between(13, 19), "card"))
    return kind.when(whole(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"), "iban").otherwise("secret")


def named_parts(titled: Column) -> Column:
    """The names in a match of TITLED or TITLED_HAN, as an array of (kind, entity): a family name, or a given name and a family name, or a whole Han name.

    A given name has a kind for each gender; where the title doesn't tell, its ending does."""
    han = titled.rlike(r"\p{IsHan}|さん")
    after = F.regexp_extract(titled, rf"({_AFTER})$", 1)
    name = F.regexp_replace(titled, rf"(?:{_AFTER})$", "")
    gender_han = F.when(after.isin(SUFFIXES["f"]), "f").otherwise("m")
    title, first, last = F.lower(F.regexp_extract(titled, r"^([^ .]+)", 1)), F.get(F.split(titled, " "), F.lit(1)), F.get(F.split(titled, " "), F.lit(2))
    gender = F.when(title.isin([t.lower() for t in TITLES["f"]]), "f").when(title.isin([t.lower() for t in TITLES["n"]]) & F.lower(first).rlike("[aаяαηe]$"), "f").otherwise("m")
    entity = lambda kind, x: F.struct(kind.alias("kind"), x.alias("entity"))
    alone = F.array(entity(F.lit("family"), first))
    both = F.array(entity(F.concat(F.lit("given-"), gender), first), entity(F.lit("family"), last))
    return F.when(han, F.array(entity(F.concat(F.lit("han-"), gender_han), name))).otherwise(F.when(last.isNull(), alone).otherwise(both))


def is_name(kind: Column) -> Column:
    return kind.rlike("^(?:family|given-|han-)")


def pick(alphabet: str | list[str], h: Column) -> Column:
    place = (F.pmod(h, F.lit(len(alphabet))) + 1).cast("int")
    return F.substr(F.lit(alphabet), place, F.lit(1)) if isinstance(alphabet, str) else F.element_at(F.array(*map(F.lit, alphabet)), place)


def reshaped(entity: Column, seed: Column, hexadecimal: Column | None = None) -> Column:
    """Each digit and letter gives way to another of its kind (case, script); all else stays. Letters of scripts that aren't listed become Latin ones."""

    def one(c: Column, i: Column) -> Column:
        h = F.xxhash64(seed, i)
        lower = pick(LETTERS["latin"], h) if hexadecimal is None else F.when(hexadecimal, pick(_HEX, h)).otherwise(pick(LETTERS["latin"], h))
        out = F.when(c.rlike(r"^\d$"), F.pmod(h, F.lit(10)).cast("string")).when(c.rlike("^[A-Z]$"), F.upper(pick(LETTERS["latin"], h))).when(c.rlike("^[a-z]$"), lower)
        for script in ("cyrillic", "greek"):
            out = out.when(c.rlike(rf"^\p{{Is{script.title()}}}$"), F.when(c.rlike(r"^\p{Lu}$"), F.upper(pick(LETTERS[script], h))).otherwise(pick(LETTERS[script], h)))
        for script, letters in CASELESS.items():
            out = out.when(c.rlike(rf"^\p{{Is{script}}}$"), pick(letters, h))
        return out.when(c.rlike(r"^\p{Lu}$"), F.upper(pick(LETTERS["latin"], h))).when(c.rlike(r"^\p{L}$"), pick(LETTERS["latin"], h)).otherwise(c)

    return F.array_join(F.transform(F.split(entity, ""), one), "")


def made_up(entity: Column, seed: Column, syllables: Column, gender: str | None) -> Column:
    """A name of so many syllables in the entity's script and case, with a gender's ending for given names."""

    def of(script: str) -> Column:
        body = F.array_join(F.transform(F.sequence(F.lit(1), syllables), lambda i: pick(SYLLABLES[script], F.xxhash64(seed, i))), "")
        return F.concat(body, pick(ENDINGS[script, gender], F.xxhash64(seed, F.lit("ending")))) if gender else body

    made = F.initcap(F.when(entity.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(entity.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin")))
    return F.when(entity == F.upper(entity), F.upper(made)).otherwise(made)


def surrogate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The replacement of an entity of a type; another attempt gives another one, and from GROWS on a longer one. The same key gives the same replacements."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, entity, attempt.cast("string")), 256)
    more = F.greatest(attempt - GROWS + 1, F.lit(0))
    # Hexadecimal digits, so many that the space grows 65,536 times with each attempt.
    tail = F.substring(seed, F.lit(1), F.least(4 * more, F.lit(64)))
    at = F.regexp_extract(entity, r"^(.*)\.[^.]*$", 1)
    email = F.concat(tail, reshaped(at, seed), F.regexp_extract(entity, r"(\.[^.]*)$", 1))
    country = F.regexp_extract(entity, r"^(\+\d{1,3}(?=[ .(-]))", 1)
    # Digits from 2 to 9 stay such, so area codes stay valid.
    phone = F.concat(country, F.array_join(F.transform(F.split(F.substr(entity, F.length(country) + 1), ""), lambda c, i: F.when(c.rlike("^[2-9]$"), (F.pmod(F.xxhash64(seed, i), F.lit(8)) + 2).cast("string")).when(c.rlike("^[01]$"), F.pmod(F.xxhash64(seed, i), F.lit(10)).cast("string")).otherwise(c)), ""))
    ip = F.array_join(F.transform(F.split(entity, r"\."), lambda c, i: (F.pmod(F.xxhash64(seed, i), F.lit(254)) + 1).cast("string")), ".")
    body = F.concat(F.substr(entity, F.lit(1), F.lit(1)), reshaped(F.substr(entity, F.lit(2), F.length(entity) - 2), seed))
    card = F.concat(body, F.pmod(10 - luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string"))
    iban = F.concat(F.substr(entity, F.lit(1), F.lit(2)), reshaped(F.substr(entity, F.lit(3)), seed))
    secret = F.concat(reshaped(entity, seed, entity.rlike("^[0-9a-f]+$")), tail)
    number = lambda x: F.concat(x, F.when(more > 0, F.concat(F.lit("-"), F.conv(F.substring(seed, 1, 12), 16, 10))).otherwise(F.lit("")))
    out = F.when(kind == "email", email).when(kind == "phone", number(phone)).when(kind == "ip", number(ip)).when(kind == "card", number(card)).when(kind == "iban", number(iban)).when(kind == "ssn", number(reshaped(entity, seed)))
    long = F.lit(3) + more
    out = out.when(kind == "family", made_up(entity, seed, long, None)).when(kind == "given-f", made_up(entity, seed, long - 1, "f")).when(kind == "given-m", made_up(entity, seed, long - 1, "m"))
    han = lambda letters: F.concat(pick(FAMILY_HAN, F.xxhash64(seed)), F.array_join(F.transform(F.slice(F.split(entity, ""), F.lit(2), F.length(entity)), lambda _, i: pick(letters, F.xxhash64(seed, i))), ""), F.array_join(F.transform(F.slice(F.split(tail, ""), F.lit(1), 2 * more), lambda c, i: pick(letters, F.xxhash64(seed, F.lit("more"), i))), ""))
    return out.when(kind == "han-f", han(GIVEN_HAN["f"])).when(kind == "han-m", han(GIVEN_HAN["m"])).otherwise(secret)


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, entity, new for distinct entities (kind, entity); no two have one surrogate, and no surrogate is itself an entity.

    Of entities that drew one surrogate, the first keeps it; the others draw again, and all are checked anew. Surrogates of later draws are
    longer, so it ends even where every form of an entity's length is taken."""
    draw = lambda t: t.withColumn("new", surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), key))
    table = materialize(draw(entities.withColumn("attempt", F.lit(0))))
    entity = F.struct("kind", "entity")
    while True:
        kept = table.groupBy("new").agg(F.min(entity).alias("keeper"), F.count("*").alias("n")).where("n > 1").select("new", "keeper")
        taken = table.select(F.col("entity").alias("new"))
        clash = table.join(kept, "new").where(entity != F.col("keeper")).select("kind", "entity").union(table.join(taken, "new", "left_semi").select("kind", "entity")).distinct()
        clash = materialize(clash)
        if clash.isEmpty():
            return table.select("kind", "entity", "new")
        again = table.join(clash, ["kind", "entity"], "left_semi").select("kind", "entity", F.col("attempt") + 1).toDF("kind", "entity", "attempt")
        table = materialize(table.join(clash, ["kind", "entity"], "left_anti").unionByName(draw(again)))


def interleaved(text: Column, form: Column, found: Column, by: Callable[[Column], Column]) -> Column:
    """text with each match of form replaced by what by makes of it; found: the matches."""
    parts = F.split(text, form)
    return F.array_join(F.transform(parts, lambda part, i: F.concat(part, F.when(i < F.size(found), by(F.get(found, i))).otherwise(F.lit("")))), "")


def mention(entity: Column, kind: Column, words: Column) -> Column:
    """A regular expression for an entity's mentions in a text: whole words as they were found, with a capital or all in capitals; in lower case, which common words have too, only behind a title. Han names of one character only before one."""
    forms = F.array_join(F.array_union(F.filter(words, lambda w: w != F.lower(w)), F.array(entity, F.upper(entity))), "|")
    word = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), forms, F.lit(rf"|{_TOLD}(?iu:"), entity, F.lit(r"))(?![\p{L}\p{N}])"))
    return F.when(kind.startswith("han-"), F.when(F.length(entity) > 1, entity).otherwise(F.concat(entity, F.lit(f"(?={_AFTER})")))).otherwise(word)


def named(word: Column) -> Column:
    """The key of a name in the map of surrogates: names in another case are the same name."""
    return F.concat(F.lit("\u0001"), F.lower(word))


def renamed(word: Column) -> Column:
    """The surrogate of a mention, in its case."""
    new = F.element_at("news", named(word))
    cased = F.when((F.upper(word) == word) & (F.length(word) > 1) & (F.lower(word) != word), F.upper(new)).when((F.lower(word) == word) & (F.upper(word) != word), F.lower(new)).otherwise(new)
    return F.coalesce(cased, word)


def replace_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "surrogates") -> DataFrame:
    """One row per input row: doc_id, n_entities, text with surrogates.

    Entities are emails, phone and social security numbers, IPv4 addresses, cards (by Luhn check), IBANs, keys after a telling word, and names
    next to a title; where a titled name stands, its words are also replaced wherever else they stand in that text, as they are, with a capital or in capitals,
    and in any case behind a title. A name has one surrogate whatever its case, which each mention keeps. One entity has one
    surrogate in all texts, and two have two: the table of distinct entities, of names too, is checked for collisions. Each word of a name is
    an entity, and each mention counts.
    The surrogates reach the texts by two 64-bit hashes of the text, so rows that repeat an id or a text, and those without an id, are treated
    like others. Null texts stay null, with no entity; texts without entities come back unchanged; an empty table gives an empty one.
    Very long texts are read whole. Other columns are not read."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("text"), "text")})
    text = F.col("text")
    titles = reduce(or_, (F.contains(text, F.lit(f"{t}{end}")) for t in [*_TITLES, *(t.upper() for t in _TITLES), "mr", "mrs", "ms", "M"] for end in ((". ",) if t == "M" else (" ", ". "))))
    suffixes = reduce(or_, (F.contains(text, F.lit(t)) for t in sum(SUFFIXES.values(), [])))
    all_of = lambda form: F.array_distinct(F.regexp_extract_all("text", F.lit(form), F.lit(0)))
    # One row per text with arrays, before any filter, which would run the expressions twice.
    found = materialize(docs.select("h1", "h2", F.when(text.rlike(HINT), all_of(ENTITY)).alias("plain"), F.when(titles, all_of(TITLED)).alias("titled"), F.when(suffixes, all_of(TITLED_HAN)).alias("han")))
    plain = found.select("h1", "h2", F.explode("plain").alias("entity")).withColumn("kind", kind_of(F.col("entity"))).where("kind IS NOT NULL")
    titled = found.select("h1", "h2", F.explode("titled").alias("titled")).union(found.select("h1", "h2", F.explode("han")))
    names = titled.select("h1", "h2", F.explode(named_parts(F.col("titled"))).alias("x")).select("h1", "h2", F.initcap(F.lower("x.entity")).alias("entity"), "x.kind", F.col("x.entity").alias("word"))
    matches = materialize(plain.withColumn("word", F.col("entity")).union(names).distinct())
    table = distinct_surrogates(matches.select("kind", "entity").distinct(), key)
    # A word that is a given name and a family name in one text has the first one's surrogate there.
    pairs = matches.join(table, ["kind", "entity"]).groupBy("h1", "h2", "entity", is_name(F.col("kind")).alias("is_name")).agg(F.min_by(F.struct("kind", "new"), "kind").alias("first"), F.sort_array(F.collect_set("word")).alias("words"))
    form = F.sort_array(F.collect_set(F.when(F.col("is_name"), F.struct((-F.length("entity")).alias("n"), mention(F.col("entity"), F.col("first.kind"), F.col("words")).alias("form")))))
    chars = F.sum(F.length("entity") + F.length("first.new"))
    maps = materialize(pairs.groupBy("h1", "h2").agg(F.map_from_entries(F.collect_list(F.struct(F.when(F.col("is_name"), named(F.col("entity"))).otherwise(F.col("entity")), "first.new"))).alias("news"), F.nullif(F.array_join(F.transform(form, lambda x: x["form"]), "|"), F.lit("")).alias("form"), chars.alias("chars")))
    n, size = maps.agg(F.count("*"), F.coalesce(F.sum("chars"), F.lit(0))).first()
    maps = maps.drop("chars")
    rows = docs.join(F.broadcast(maps) if n <= BROADCAST_TEXTS and size <= BROADCAST_CHARS else maps, ["h1", "h2"], "left")
    known = F.col("news").isNotNull()
    rows = rows.withColumn("found", F.when(known, F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))))
    n_plain = F.when(known, F.size(F.filter("found", lambda e: F.map_contains_key("news", e)))).otherwise(0)
    rows = rows.select("doc_id", "news", "form", n_plain.alias("n_plain"), F.when(known, interleaved(text, F.lit(ENTITY), F.col("found"), lambda e: F.coalesce(F.element_at("news", e), e))).otherwise(text).alias("text"))
    rows = rows.withColumn("mentions", F.when(F.col("form").isNotNull(), F.regexp_extract_all("text", F.col("form"), F.lit(0))))
    replaced = F.when(F.col("form").isNotNull(), interleaved(text, F.col("form"), F.col("mentions"), renamed)).otherwise(text)
    n_names = F.when(F.col("form").isNotNull(), F.size("mentions")).otherwise(0)
    return rows.select("doc_id", F.when(text.isNull(), 0).otherwise(F.col("n_plain") + n_names).cast("long").alias("n_entities"), replaced.alias("text"))


def op5_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    return replace_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
