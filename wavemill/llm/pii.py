"""PII surrogates: keyed, type-consistent replacements, made by DataFrame expressions only.

Detected are e-mail addresses, phone numbers, IPv4 addresses, payment card numbers (13 to 19 digits that
pass the Luhn check), social security numbers, secrets (long hexadecimal strings and well-known key
forms) and personal names. A name is found by a title ("Dr. Jane Smith"). The full names so found are
then known in all documents, with or without a title, and in a document that mentions a known person
every other occurrence of that person's names counts as well.

Kinds with a fixed form are replaced by a keyed permutation of all values of the same shape (a Feistel
network with HMAC-SHA256 rounds). So the replacement of a value depends on the key alone, all spellings
of a value share it (coreference), and different values never share one, however many of them there are
(distinctness): there is nothing to draw again. Shapes are

* phone numbers: country digits, separators, and whether the area code may start a real number;
* addresses: 10/8, 127/8, 169.254/16, 172.16/12, 192.168/16, multicast, reserved, 0/8, or public;
* cards: length and issuer digit, and the Luhn check holds; social security numbers: a valid area or not;
* e-mails: length and character classes of the local part and of the labels before the last; the last
  label is kept and followed by ``.example``, so that no surrogate can be delivered;
* secrets: prefix, length, alphabet (hexadecimal) or classes and case of the characters.

Names are replaced word by word, so that "John Smith", "Mr. Smith", "Dr. Smith" and a bare "Smith" stay one
person: family names by syllables, given names by given names of the gender (told by the title, else by
the titles that the full name, then the given name, has elsewhere, else drawn) and of the script (Latin or
Cyrillic). Titles, number of words and capitals stay. Words are drawn from HMAC of kind, word and attempt,
and checked for collisions: of several words that draw the same surrogate the smallest keeps it, and
a surrogate that is itself a name found in the corpus is not used; the others draw again, each time from
a space 16 times as large, until none collides. This dictionary grows with the number of distinct name
words; it is only ever shuffled, never collected, and broadcast only if it is small.

A surrogate of a permuted kind may equal another value of the corpus where a shape is used densely; two
values still never share a surrogate.

A null text stays null with no entities; an empty text stays empty. Very long texts are processed whole.
Rows that share an id are told apart by their text; equal rows get equal results. Null ids are rows like
others. An empty table gives no rows. Columns named n_entities and kinds are replaced, all others kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, spread_join, written

# Titles by gender, given names by gender and script, syllables of family names by script.
MALE_TITLES = "Mr|Sir|Herr|Monsieur|Señor|Signor|Г-н|Господин"
FEMALE_TITLES = "Mrs|Ms|Miss|Madam|Frau|Madame|Señora|Signora|Г-жа|Госпожа"
OTHER_TITLES = "Dr|Prof"
GIVEN = {
    "latin_m": "Adam Bruno Carl David Emil Felix Georg Henry Ivan James Karl Louis Martin Nico Oscar Peter",
    "latin_f": "Anna Berta Clara Diana Emma Fiona Greta Helen Irene Julia Karin Laura Marie Nora Olga Petra",
    "cyrillic_m": "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Семён",
    "cyrillic_f": "Анна Белла Вера Галина Дарья Ева Жанна Зоя Ирина Карина Лидия Мария Нина Ольга Полина Раиса",
}
SYLLABLES = {
    "latin": "bar den fel gor han jul kem lor man nor pel ras sel tam vor wen",
    "cyrillic": "бар ден фел гор хан жул кем лор ман нор пел рас сел там вор вен",
}
#: Private and special blocks of IPv4 between 1.0.0.0 and 224.0.0.0: (first address, number of addresses).
BLOCKS = [(10 << 24, 1 << 24), (127 << 24, 1 << 24), ((169 << 24) + (254 << 16), 1 << 16), ((172 << 24) + (16 << 16), 1 << 20), ((192 << 24) + (168 << 16), 1 << 16)]
#: Name words per document are kept in this many small maps.
BUCKETS = 64
#: Map entries up to this number (some 30 MB) are broadcast to the texts.
BROADCAST_ENTRIES = 300_000

_TITLES = rf"(?:(?:{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES})\.? )++"
_WORD = r"\p{Lu}(?:\p{L}++|(?=['’]))(?:['’-]\p{L}{2,}+)*+"
_START = r"(?<![\p{L}\p{N}_])"
#: Alternatives in the order in which they are tried at a place. Repeated groups are possessive: they neither go back nor recurse.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}_.%+-])[\p{L}\p{N}_.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z_+])(?:\+[0-9]{1,3}[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|\+[0-9]{1,3}[ .-][0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z_-])",
    "ip": r"(?<![0-9A-Za-z_.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9A-Za-z_]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z_-])",
    "secret": r"(?<![0-9A-Za-z_])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![0-9A-Za-z_])",
    "card": r"(?<![0-9A-Za-z_-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z_-])",
    "name": rf"{_START}{_TITLES}{_WORD}(?: {_WORD}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: The same or any capitalised word.
ANY_OR_WORD = f"{ANY}|(?:{_START}{_WORD})"
#: Capitalised words in a row.
RUN = f"{_START}{_WORD}(?: {_WORD})++"


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with name bound to value."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


class Permutations:
    """SQL for keyed permutations; ``v`` is the value as it is spelled."""

    def __init__(self, key: str):
        block = key.encode()
        if not block:
            raise ValueError("a key is required")
        if len(block) > 64:
            import hashlib

            block = hashlib.sha256(block).digest()
        block = block.ljust(64, b"\0")
        self.inner, self.outer = (bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))

    def hmac(self, *parts: str) -> str:
        """HMAC-SHA256 (hexadecimal) of the parts, joined by bars."""
        return f"sha2(concat(X'{self.outer}', unhex(sha2(concat(X'{self.inner}', encode(concat_ws('|', {', '.join(parts)}), 'UTF-8')), 256))), 256)"

    def numbers(self, tweak: str, hi: str, a: str, lo: str, b: str) -> str:
        """struct(hi, lo): a permutation of the pairs with hi < a and lo < b."""
        moved = lambda x, by, most: f"(s.{x} + cast(conv(substr({self.hmac(tweak, 'i', f's.{by}')}, 1, 15), 16, 10) as bigint)) % ({most})"
        return (
            f"aggregate(sequence(1, 8), named_struct('hi', cast({hi} as bigint), 'lo', cast({lo} as bigint)), (s, i) -> case when i % 2 = 1"
            f" then named_struct('hi', {moved('hi', 'lo', a)}, 'lo', s.lo) else named_struct('hi', s.hi, 'lo', {moved('lo', 'hi', b)}) end)"
        )

    def characters(self, tweak: str, text: str, hexadecimal: bool = False) -> str:
        """A permutation of the texts with the same classes of characters at the same places."""
        n = f"cast(conv(substr({self.hmac('q', 'k div 16')}, 4 * (k % 16) + 1, 4), 16, 10) as int)"
        if hexadecimal:
            turned = f"substr('0123456789abcdef', (instr('0123456789abcdef', c) - 1 + {n}) % 16 + 1, 1)"
        else:
            turned = "case " + " ".join(f"when c between '{x}' and '{y}' then char({ord(x)} + (ascii(c) - {ord(x)} + {n}) % {ord(y) - ord(x) + 1})" for x, y in ("09", "az", "AZ")) + " else c end"
        half = lambda x, by: _let("q", self.hmac(tweak, "i", f"s.{by}"), f"array_join(transform(filter(split(s.{x}, ''), c -> c <> ''), (c, k) -> {turned}), '')")
        rounds = (
            "aggregate(sequence(1, 6), named_struct('l', substr(t, 1, length(t) div 2), 'r', substr(t, length(t) div 2 + 1)), (s, i) -> case when i % 2 = 1"
            f" then named_struct('l', {half('l', 'r')}, 'r', s.r) else named_struct('l', s.l, 'r', {half('r', 'l')}) end)"
        )
        return _let("t", text, _let("e", rounds, "concat(e.l, e.r)"))

    def phone(self) -> str:
        ten = self.numbers("concat('phone|', substr(d, 1, length(d) - 10), '|', f > 1)", "n div 100000 - if(f > 1, 20000, 0)", "if(f > 1, 80000, 20000)", "n % 100000", "100000")
        text = "concat(substr(d, 1, length(d) - 10), lpad(p.hi + if(f > 1, 20000, 0), 5, '0'), lpad(p.lo, 5, '0'))"
        return _let("d", _DIGITS, _let("n", "cast(right(d, 10) as bigint)", _let("f", "n div 1000000000", _let("p", ten, text))))

    def ssn(self) -> str:
        """Areas 001 to 899 but 666 stay such areas, all others stay the area that they are."""
        real = self.numbers("'ssn'", "(area - if(area > 666, 2, 1)) * 100 + n div 10000 % 100", "89800", "n % 10000", "10000")
        other = self.numbers("concat('ssn|', area)", "n div 10000 % 100", "100", "n % 10000", "10000")
        one = "concat(lpad(p.hi div 100 + if(p.hi div 100 > 664, 2, 1), 3, '0'), lpad(p.hi % 100, 2, '0'), lpad(p.lo, 4, '0'))"
        two = "concat(lpad(area, 3, '0'), lpad(p.hi, 2, '0'), lpad(p.lo, 4, '0'))"
        return _let("n", f"cast({_DIGITS} as bigint)", _let("area", "n div 1000000", f"case when area between 1 and 899 and area <> 666 then {_let('p', real, one)} else {_let('p', other, two)} end"))

    def card(self) -> str:
        u, w = "(length(d) - 2) div 2", "length(d) - 2 - (length(d) - 2) div 2"
        power = lambda n: f"cast(pow(10, {n}) as bigint)"
        body = self.numbers("concat('card|', substr(d, 1, 1), '|', length(d))", f"substr(d, 2, {u})", power(u), f"substr(d, 2 + {u}, {w})", power(w))
        text = f"concat(substr(d, 1, 1), lpad(p.hi, {u}, '0'), lpad(p.lo, {w}, '0'))"
        return _let("d", _DIGITS, _let("p", body, _let("b", text, f"concat(b, (10 - {_luhn('b', 1)} % 10) % 10)")))

    def ip(self) -> str:
        number = "aggregate(split(v, '[.]'), cast(0 as bigint), (t, x) -> t * 256 + cast(x as bigint))"
        text = lambda n: _let("z", n, "concat_ws('.', z div 16777216, z div 65536 % 256, z div 256 % 256, z % 256)")
        block = lambda name, first, a, b: _let("p", self.numbers(f"'ip|{name}'", f"(n - {first}) div {b}", str(a), f"(n - {first}) % {b}", str(b)), text(f"{first} + p.hi * {b} + p.lo"))
        inside = [*BLOCKS, (0, 1 << 24), (224 << 24, 16 << 24), (240 << 24, 16 << 24)]
        cases = " ".join(f"when n >= {first} and n < {first + size} then {block(k, first, size >> 8, 256)}" for k, (first, size) in enumerate(inside))
        # public addresses: numbered without the blocks
        place = "n - 16777216" + "".join(f" - if(n > {first}, {size}, 0)" for first, size in BLOCKS)
        count = (223 << 24) - sum(size for _, size in BLOCKS)
        back = "p.hi * 65536 + p.lo + 16777216"
        for k, (first, size) in enumerate(BLOCKS):
            back = _let(f"y{k}", back, f"y{k} + if(y{k} >= {first}, {size}, 0)")
        public = _let("m", place, _let("p", self.numbers("'ip|public'", "m div 65536", str(count >> 16), "m % 65536", "65536"), text(back)))
        return _let("n", number, f"case {cases} else {public} end")

    def email(self) -> str:
        last = "substring_index(w, '.', -1)"
        head = self.characters("'domain'", f"substr(w, 1, length(w) - length({last}) - 1)")
        local = self.characters("concat('email|', w)", "split_part(lower(v), '@', 1)")
        out = _let("w", "split_part(lower(v), '@', -1)", f"concat({local}, '@', {head}, '.', {last}, '.example')")
        return f"case when v = upper(v) then upper({out}) else {out} end"

    def secret(self) -> str:
        hexadecimal = self.characters("'secret'", "lower(v)", True)
        prefix = "if(v like 'sk-%', 3, 4)"
        other = self.characters(f"concat('secret|', substr(v, 1, {prefix}))", f"substr(v, {prefix} + 1)")
        return f"case when v rlike '^[0-9a-f]+$' then {hexadecimal} when v rlike '^[0-9A-F]+$' then upper({hexadecimal}) else concat(substr(v, 1, {prefix}), {other}) end"

    def of(self, kind: str) -> str:
        """The surrogate of value ``v``, as it is shown; null for names and other values."""
        number = " ".join(f"when '{k}' then {_let('sur', getattr(self, k)(), _SPELLED)}" for k in ("phone", "card", "ssn"))
        return f"case {kind} {number} when 'ip' then {self.ip()} when 'email' then {self.email()} when 'secret' then {self.secret()} end"


_DIGITS = "regexp_replace(v, '[^0-9]', '')"
#: The digits of ``sur`` in the places of the digits of ``v``.
_SPELLED = (
    "aggregate(filter(split(v, ''), c -> c <> ''), named_struct('out', '', 'i', 1), (a, c) -> case when c between '0' and '9'"
    " then named_struct('out', concat(a.out, substr(sur, a.i, 1)), 'i', a.i + 1) else named_struct('out', concat(a.out, c), 'i', a.i) end, a -> a.out)"
)
#: Pairs and triples of neighbouring words of ``w``.
_GRAMS = (
    "concat(transform(sequence(1, size(w) - 1), i -> concat_ws(' ', w[i - 1], w[i])),"
    " if(size(w) > 2, transform(sequence(1, greatest(size(w) - 2, 1)), i -> concat_ws(' ', w[i - 1], w[i], w[i + 1])), array()))"
)


def _luhn(digits: str, doubled: int) -> str:
    """SQL: the Luhn sum; of the places from the right, 1 first, the odd (1) or even (0) ones are doubled."""
    return f"aggregate(transform(filter(split(reverse({digits}), ''), c -> c <> ''), (c, k) -> cast(c as bigint) * if((k + 1) % 2 = {doubled}, 2, 1)), cast(0 as bigint), (t, x) -> t + x - if(x > 9, 9, 0))"


def kind_of() -> str:
    """SQL: the kind of value ``v``, a match of ANY_OR_WORD; 'word' for a capitalised word, 'none' for digits that are no card."""
    cases = [f"when v rlike {_q('^(?:' + PATTERNS[k] + ')$')} then " + (f"if({_luhn(_DIGITS, 0)} % 10 = 0, 'card', 'none')" if k == "card" else f"'{k}'") for k in PATTERNS]
    return f"case {' '.join(cases)} else 'word' end"


def _bare(v: str) -> str:
    """SQL: a name without its titles."""
    return f"regexp_replace({v}, {_q('^' + _TITLES)}, '')"


def _gender(v: str) -> str:
    """SQL: m or f as the titles of a name tell, else null."""
    one = lambda titles: f"rlike(regexp_extract({v}, {_q('^' + _TITLES)}, 0), {_q(f'(?:^| )(?:{titles})[.]? ')})"
    return f"case when {one(FEMALE_TITLES)} then 'f' when {one(MALE_TITLES)} then 'm' end"


def _draw_words(words: DataFrame, keyed: Permutations) -> DataFrame:
    """Adds ``sur`` (lower case) to (kind, form, attempt)."""
    pick = lambda text: f"element_at(split('{text}', ' '), cast(conv(substr(draw, (i - 1) % 64 + 1, 1), 16, 10) as int) + 1)"
    script = "if(form rlike '\\\\p{IsCyrillic}', 'cyrillic', 'latin')"
    cases = [f"when kind = 'family' and {script} = '{s}' then array_join(transform(sequence(1, 3 + attempt), i -> {pick(w)}), '')" for s, w in SYLLABLES.items()]
    cases += [f"when kind = 'given_{g}' and {script} = '{s}' then array_join(transform(sequence(1, 1 + attempt), i -> {pick(GIVEN[f'{s}_{g}'])}), '-')" for s in SYLLABLES for g in "mf"]
    return words.withColumn("draw", F.expr(keyed.hmac("kind", "form", "cast(attempt as string)"))).withColumn("sur", F.expr(f"lower(case {' '.join(cases)} end)")).drop("draw")


def dictionary(words: DataFrame, keyed: Permutations, folder: str) -> DataFrame:
    """(kind, form, sur) of distinct name words (kind, form), with distinct surrogates none of which is a name word."""
    forms = words.select(F.col("form").alias("sur"), F.lit(True).alias("is_form")).distinct()
    now, attempt = _draw_words(words.withColumn("attempt", F.lit(0)), keyed), 0
    while True:
        now = written(now, folder, f"drawn{attempt}")
        keeps = now.groupBy("sur").agg(F.min(F.struct("form", "kind")).alias("keeps"))
        judged = now.join(keeps, "sur").join(forms, "sur", "left").withColumn("again", (F.struct("form", "kind") != F.col("keeps")) | F.col("is_form").isNotNull())
        judged = written(judged.select("kind", "form", "attempt", "sur", "again"), folder, f"judged{attempt}")
        if attempt:
            discard(words.sparkSession, folder, f"drawn{attempt - 1}")
            discard(words.sparkSession, folder, f"judged{attempt - 1}")
        if not judged.where("again").take(1):
            return judged.select("kind", "form", "sur")
        attempt += 1
        now = judged.where("not again").drop("again").unionByName(_draw_words(judged.where("again").select("kind", "form", (F.col("attempt") + 1).alias("attempt")), keyed))


def _majority(rows: DataFrame, by: str) -> DataFrame:
    """(by, g): the gender that most of the rows tell, null if none or both alike."""
    lead = F.sum(F.when(F.col("g") == "m", 1).when(F.col("g") == "f", -1).otherwise(0))
    return rows.groupBy(by).agg(F.when(lead > 0, "m").when(lead < 0, "f").alias("g"))


def _names(base: DataFrame, keyed: Permutations, folder: str) -> DataFrame:
    """(_wm_id2, _wm_tid2, _wm_names, _wm_n): per text, in buckets, what its names (v: with their titles, w: word by word) become."""
    ids = ["_wm_id", "_wm_tid"]
    values = F.array_distinct(F.transform(F.filter("_wm_e", lambda e: e["kind"] == "name"), lambda e: e["value"]))
    titled = base.select(*ids, F.explode(values).alias("v")).distinct()
    titled = written(titled.select(*ids, "v", F.expr(_gender("v")).alias("g"), F.expr(f"lower({_bare('v')})").alias("name")), folder, "titled")
    known = _majority(titled.where("instr(name, ' ') > 0"), "name")
    grams = base.select(*ids, F.explode("_wm_grams").alias("name")).distinct()
    counted = written(grams.groupBy("name").agg(F.count(F.lit(1)).alias("c")).join(known.select("name"), "name"), folder, "known")
    nothing = F.lit(None).cast("string")
    bare = spread_join(grams, counted, "name", "c", "_wm_tid").select(*ids, nothing.alias("v"), nothing.alias("g"), "name")
    mentions = written(titled.unionByName(bare).withColumn("form", F.concat_ws("|", F.coalesce("g", F.lit("")), "name")), folder, "mentions")
    # every distinct form of a mention is resolved once
    forms = mentions.groupBy("form").agg(F.first("g").alias("g"), F.first("name").alias("name"), F.count(F.lit(1)).alias("c"))
    words = forms.select("form", "g", "name", "c", F.posexplode(F.split("name", " ")).alias("i", "word"), (F.size(F.split("name", " ")) - 1).alias("last"))
    by_word = _majority(words.where("i < last and g is not null").select("word", "g"), "word").withColumnRenamed("g", "g_word")
    words = words.join(known.withColumnRenamed("g", "g_name"), "name", "left").join(by_word, "word", "left")
    drawn = F.expr(f"if(conv(substr({keyed.hmac(_q('gender'), 'word')}, 1, 1), 16, 10) % 2 = 0, 'm', 'f')")
    words = words.withColumn("kind", F.when(F.col("i") == F.col("last"), "family").otherwise(F.concat(F.lit("given_"), F.coalesce("g", "g_name", "g_word", drawn))))
    words = written(words.select("form", "c", "i", "kind", "word"), folder, "words")
    made = dictionary(words.select("kind", F.col("word").alias("form")).distinct(), keyed, folder).withColumnRenamed("form", "word")
    parts = F.struct("i", "word", "sur", (F.col("kind") != "family").cast("int").alias("rank"))
    shown = words.join(made, ["kind", "word"]).groupBy("form").agg(F.first("c").alias("c"), F.array_sort(F.collect_list(parts)).alias("m"))  # a name has at most three words
    found = spread_join(mentions, written(shown, folder, "shown"), "form", "c", "_wm_tid")
    # a word that is both a family and a given name in one text stands for the family name
    entries = F.expr(
        "concat(transform(filter(array(v), x -> x is not null), x -> named_struct('key', concat('v:', x), 'rank', 0, 'sur', array_join(transform(m, y -> y.sur), ' '))),"
        " transform(m, x -> named_struct('key', concat('w:', x.word), 'rank', x.rank, 'sur', x.sur)))"
    )
    one = found.select(*ids, F.explode(entries).alias("x")).groupBy(*ids, F.col("x.key").alias("key")).agg(F.min(F.struct("x.rank", "x.sur")).alias("best"))
    bucket = F.pmod(F.hash("key"), F.lit(BUCKETS)).alias("bucket")
    some = one.groupBy(*ids, bucket).agg(F.map_from_entries(F.collect_list(F.struct("key", "best.sur"))).alias("m"), F.count(F.lit(1)).alias("n"))
    per_doc = some.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "m"))).alias("_wm_names"), F.sum("n").alias("_wm_n"))
    return written(per_doc.withColumnsRenamed({"_wm_id": "_wm_id2", "_wm_tid": "_wm_tid2"}), folder, "names")


def _replaced(keyed: Permutations) -> str:
    """SQL: array of struct(kind, out) from the (kind, value) in ``_wm_found``; kind is null for what stays."""
    get = lambda key: f"_wm_names[pmod(hash({key}), {BUCKETS})][{key}]"
    # initcap looks at blanks only; parts of a given name are joined by hyphens
    recased = lambda v, sur: f"if(length({v}) > 1 and {v} = upper({v}), upper({sur}), replace(initcap(replace({sur}, '-', ' - ')), ' - ', '-'))"
    word = _let("sur", get("concat('w:', lower(v))"), f"named_struct('kind', if(sur is null, null, 'name'), 'out', coalesce({recased('v', 'sur')}, v))")
    both = f"zip_with(split({_bare('v')}, ' '), split({get("concat('v:', v)")}, ' '), (a, b) -> {recased('a', 'b')})"
    name = f"named_struct('kind', 'name', 'out', concat(substr(v, 1, length(v) - length({_bare('v')})), array_join({both}, ' ')))"
    fixed = f"named_struct('kind', nullif(e.kind, 'none'), 'out', coalesce({keyed.of('e.kind')}, v))"
    out = f"case e.kind when 'name' then {name} when 'word' then {word} else {fixed} end"
    return f"transform(_wm_found, e -> {_let('v', 'e.value', out)})"


def surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its text column replaced, and n_entities and kinds (sorted distinct entity types) added; ``key`` is a secret."""
    keyed = Permutations(key)
    folder = scratch(docs.sparkSession)
    docs = docs.drop("n_entities", "kinds")
    columns = docs.columns
    matches = lambda pattern: F.expr(f"transform(regexp_extract_all(_wm_text, {_q(pattern)}, 0), v -> named_struct('kind', {kind_of()}, 'value', v))")
    grams = F.expr(f"array_distinct(flatten(transform(regexp_extract_all(_wm_text, {_q(RUN)}, 0), r -> {_let('w', 'split(lower(r), ' + _q(' ') + ')', _GRAMS)})))")
    base = docs.select(F.struct(*columns).alias("_wm_row"), F.col(id_col).alias("_wm_id"), F.col(text_col).alias("_wm_text")).withColumn("_wm_tid", F.xxhash64("_wm_text"))
    # texts are searched once
    base = written(base.withColumn("_wm_e", matches(ANY)).withColumn("_wm_grams", grams).drop("_wm_text"), folder, "base")
    named = F.exists("_wm_e", lambda e: e["kind"] == "name")
    nothing = F.lit(None).cast("map<int,map<string,string>>").alias("_wm_names")
    if base.where(named).take(1):
        names = _names(base, keyed, folder)
        same = F.col("_wm_id").eqNullSafe(F.col("_wm_id2")) & (F.col("_wm_tid") == F.col("_wm_tid2"))
        entries = names.agg(F.sum("_wm_n")).first()[0] or 0
        wanted = ["_wm_row", "_wm_e", "_wm_names"]
        if entries <= BROADCAST_ENTRIES:
            base = base.join(F.broadcast(names), same, "left").select(*wanted)
        else:
            # only texts that may hold a name are shuffled
            may = F.coalesce(named | (F.size("_wm_grams") > 0), F.lit(False))
            base = base.where(may).join(names, same, "left").select(*wanted).unionAll(base.where(~may).select("_wm_row", "_wm_e", nothing))
    else:
        base = base.select("_wm_row", "_wm_e", nothing)
    has_names = F.col("_wm_names").isNotNull()
    base = base.withColumn("_wm_text", F.col("_wm_row")[text_col])
    base = base.withColumn("_wm_found", F.when(has_names, matches(ANY_OR_WORD)).when(F.size("_wm_e") > 0, F.col("_wm_e")))
    base = base.withColumn("_wm_made", F.expr(_replaced(keyed)))
    gaps = F.when(has_names, F.split("_wm_text", ANY_OR_WORD, -1)).otherwise(F.split("_wm_text", ANY, -1))
    pieces = F.zip_with(gaps, F.concat(F.transform("_wm_made", lambda m: m["out"]), F.array(F.lit(""))), lambda g, s: F.concat(g, s))
    told = F.filter(F.transform("_wm_made", lambda m: m["kind"]), lambda k: k.isNotNull())
    new = F.when(F.col("_wm_made").isNull(), F.col("_wm_text")).otherwise(F.array_join(pieces, ""))
    return base.select(
        *[new.alias(c) if c == text_col else F.col("_wm_row")[c].alias(c) for c in columns],
        F.when(F.col("_wm_made").isNull(), 0).otherwise(F.size(told)).cast("long").alias("n_entities"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(told)), ","), F.lit("")).alias("kinds"),
    )
