"""PII surrogates: detected entities get keyed replacements of their own kind.

An entity's canonical form (digits of a number, lower-case address, name without title)
and a secret key give its surrogate, so all its mentions get the same one. Letters stay
letters, digits digits, separators stay; check digits stay valid; names keep gender and
script. Surrogates of the whole corpus are held against each other and against all real
entities, and those that collide are drawn again, so different entities stay different.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from citeloom.llm.common import stored

#: A surrogate that still collides after so many draws means that its format has no room left.
MAX_DRAWS = 64

# Given names by script and gender, and syllables for surnames by script.
GIVEN = {
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Karen Margaret Sandra Ashley Emily Michelle Amanda Melissa Deborah Rebecca Laura Sophie Claudia Ingrid Carmen Dolores".split(),
    ("latin", "m"): "James Robert Michael David William Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Andrew Kenneth Joshua Kevin George Timothy Edward Jürgen Pierre Carlos Fernando".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Людмила".split(),
    ("cyrillic", "m"): "Иван Александр Сергей Дмитрий Андрей Алексей Михаил Николай Владимир Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Αγγελική".split(),
    ("greek", "m"): "Γεώργιος Δημήτριος Κωνσταντίνος Ιωάννης Νικόλαος Παναγιώτης".split(),
}
#: Further given names that are detected but not given out: common ones of Europe and the Americas that are no everyday words.
KNOWN = {
    ("latin", "f"): "Alice Amelia Andrea Angela Anna Anne Annette Antonia Astrid Beatrice Birgit Brenda Camila Carla Carol Caroline Catherine Cecilia Charlotte Christina Christine Cristina Cynthia Daniela Diana Donna Dorothy Elena Eleanor Elisa Emma Erika Eva Evelyn Fatima Fiona Florence Francesca Françoise Frances Gabriela Giulia Gisela Hannah Heather Heike Helen Helena Ines Inés Irene Isabel Isabella Jacqueline Jane Janet Joanna Josephine Judith Julia Julie Karin Katharina Katherine Kathleen Kelly Kimberly Lisa Lucia Lucía Louise Luisa Magdalena Margarita Maria María Marie Marta Martha Martina Megan Monica Monika Nancy Natalia Natalie Nicole Olga Olivia Pamela Paula Petra Rachel Renate Rosa Ruth Sabine Samantha Sara Sarah Sharon Silvia Simone Sofia Sofía Sonja Stefanie Stephanie Teresa Theresa Ursula Valentina Valerie Vanessa Veronica Victoria Virginia Yvonne".split(),
    ("latin", "m"): "Aaron Adam Alan Albert Alberto Alejandro Alexander Alexandre Alfonso Alfred Andreas Andrés Ángel Antoine Antonio Arthur Benjamin Bernd Bernhard Brandon Brian Bruno Charles Christian Christoph Christopher Claude Dennis Diego Dieter Dirk Donald Douglas Eduardo Emil Enrique Eric Erik Ernst Eugene Ferdinand Florian Francesco Francis Francisco François Franz Fred Frederick Friedrich Fritz Gabriel Gary Gerald Gerhard Giovanni Giuseppe Gregory Guillermo Günter Gustav Hans Harald Harold Heinrich Heinz Helmut Henri Henry Herbert Hermann Hugo Ian Ignacio Ivan Jacob Jacques Jan Javier Jean Jeffrey Jens Jeremy Jerry Jesús Johann Johannes John Jonathan Jorge José Juan Julian Julien Karl Keith Klaus Konrad Larry Lars Laurent Lawrence Leonard Leonardo Lorenzo Louis Luca Lucas Ludwig Luigi Luis Lukas Manfred Manuel Marc Marco Marcos Mario Markus Martin Matthias Max Maximilian Miguel Nathan Nicholas Nicolas Nikolaus Olaf Oliver Oscar Otto Pablo Patrick Paul Paulo Pedro Peter Philip Philipp Philippe Ralf Ralph Raymond Ricardo René Roberto Rodrigo Roger Roland Rolf Ronald Rudolf Samuel Santiago Scott Sean Sebastian Sergio Simon Stefan Stephan Stephen Sven Theodor Tobias Ulrich Uwe Victor Vincent Vincenzo Walter Werner Wilhelm Wolfgang Yves Zachary".split(),
    ("cyrillic", "f"): "Александра Алина Алла Анастасия Ангелина Валентина Валерия Варвара Вера Виктория Галина Дарья Евгения Елизавета Жанна Зинаида Инна Ксения Лариса Маргарита Марина Надежда Оксана Полина Раиса София Тамара Юлия".split(),
    ("cyrillic", "m"): "Анатолий Антон Аркадий Артём Борис Вадим Валентин Валерий Василий Виктор Виталий Вячеслав Геннадий Георгий Григорий Даниил Денис Евгений Егор Игорь Илья Кирилл Константин Леонид Максим Никита Олег Пётр Роман Семён Станислав Степан Тимофей Фёдор Юрий Яков".split(),
    ("greek", "f"): "Άννα Αναστασία Γεωργία Δήμητρα Ειρήνη Ευαγγελία Ευγενία Ιωάννα Κατερίνα Κωνσταντίνα Παναγιώτα Παρασκευή Χριστίνα".split(),
    ("greek", "m"): "Αθανάσιος Αλέξανδρος Ανδρέας Αντώνιος Βασίλειος Γιάννης Γιώργος Δημήτρης Ευάγγελος Κώστας Μιχαήλ Νίκος Παύλος Πέτρος Σπυρίδων Χρήστος".split(),
}
SYLLABLES = {
    "latin": "bal den cor vel mar tin lo ras ke pol fen gar hul is jo kam lun mer nor ost pra quin ros sil tor und ves wil".split(),
    "cyrillic": "бел дан кор вел мар тин ло рас ке пол гар зим лун нор ост пра рос сил тор вес".split(),
    "greek": "βαλ δεν κορ βελ μαρ τιν λο ρασ κε πολ γαρ λουν νορ οστ πρα ροσ σιλ τορ".split(),
}
TITLES = {"Mr": "m", "Mr.": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Mrs": "f", "Mrs.": "f", "Ms": "f", "Ms.": "f", "Frau": "f", "Madame": "f", "Señora": "f"}
_GENDER = {name: kind for known in (KNOWN, GIVEN) for kind, names in known.items() for name in names}

_NUMBERS = re.compile(
    r"(?P<email>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)"
    r"|(?P<secret>\b(?=[A-Za-z_-]*\d)(?=[0-9_-]*[A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:sk|pk|ghp|gho|xox[bap]|AKIA)[-_A-Za-z0-9]{16,})\b)"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<phone>(?<![\w.])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d|\.\d)|(?<![\w.])\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)|(?<![\w.])\d{3}[-. ]\d{3}[-. ]\d{4}(?!\d))"
    r"|(?P<national>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<account>(?<![\d.,])\d(?:[ -]?\d){12,18}(?![\d]|[.,]\d))")
_NAME = "[A-ZÀ-ÖØ-ÞА-ЯΑ-ΩΆΈΉΊΌΎΏ][a-zß-öø-ÿа-яёα-ωάέήίόύώς]+"
_PERSON = re.compile(
    rf"(?P<title>\b(?:{'|'.join(sorted(map(re.escape, TITLES), key=len, reverse=True))})) (?P<titled>{_NAME}(?: {_NAME})?)"
    rf"|\b(?P<given>{'|'.join(map(re.escape, _GENDER))}) (?P<family>{_NAME})\b")
# _PERSON matches only if one of these is a whole run of word characters, whatever stands before it.
_TRIGGER = frozenset(_GENDER) | frozenset(t.rstrip(".") for t in TITLES)
_RUN = re.compile(r"\w+")


def _script(word: str) -> str:
    first = word[0]
    return "cyrillic" if "А" <= first <= "я" else "greek" if "Ά" <= first <= "ώ" else "latin"


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities of a text, in order and without overlap."""
    found = []
    if re.search(r"\d", text):
        for m in _NUMBERS.finditer(text):
            kind, value = m.lastgroup, m.group()
            canon = value.lower() if kind == "email" else value if kind in ("secret", "ip") else re.sub(r"[^0-9A-Za-z]", "", value)
            found.append((*m.span(), kind, canon))
    elif "@" in text:
        found = [(*m.span(), "email", m.group().lower()) for m in _NUMBERS.finditer(text) if m.lastgroup == "email"]
    if not _TRIGGER.isdisjoint(_RUN.findall(text)):
        taken = [(a, b) for a, b, _, _ in found]
        for m in _PERSON.finditer(text):
            if m["given"]:
                span, (script, gender) = m.span(), _GENDER[m["given"]]
                canon = f"{script}|{gender}|{m['given']} {m['family']}"
            else:
                span, first = m.span("titled"), m["titled"].split()[0]
                gender = _GENDER.get(first, (None, TITLES[m["title"]]))[1]
                canon = f"{_script(first)}|{gender}|{m['titled']}"
            if all(b <= span[0] or span[1] <= a for a, b in taken):
                found.append((*span, "person", canon))
        found.sort()
    return found


class _Stream:
    """Numbers drawn from a keyed hash."""

    def __init__(self, key: bytes, *parts: object) -> None:
        self.key, self.parts, self.block, self.left = key, "\x1f".join(map(str, parts)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.parts + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n


def _reshape(value: str, draw: _Stream) -> str:
    """Another value with the same classes of characters in the same places."""
    out = []
    hexadecimal = len(value) >= 32 and re.fullmatch("[0-9a-f]+|[0-9A-F]+", value)
    for c in value:
        if hexadecimal:
            out.append("0123456789ABCDEF"[draw.below(16)] if value.isupper() else "0123456789abcdef"[draw.below(16)])
        elif c.isdigit():
            out.append("0123456789"[draw.below(10)])
        elif "a" <= c <= "z":
            out.append("abcdefghijklmnopqrstuvwxyz"[draw.below(26)])
        elif "A" <= c <= "Z":
            out.append("ABCDEFGHIJKLMNOPQRSTUVWXYZ"[draw.below(26)])
        else:
            out.append(c)
    return "".join(out)


def luhn_digit(body: str) -> int:
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(body))))
    return -total % 10


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def surrogate(kind: str, canon: str, key: bytes, draw: int) -> str:
    """The canonical form of the replacement of an entity at a given draw."""
    s = _Stream(key, kind, canon, draw)
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        labels = domain.split(".")
        return _reshape(local, s) + "@" + ".".join([*(_reshape(x, s) for x in labels[:-1]), labels[-1]])
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "account" and luhn_digit(canon[:-1]) == int(canon[-1]):
        body = canon[0] + _reshape(canon[1:-1], s)
        return body + str(luhn_digit(body))
    if kind == "iban":
        rest = _reshape(canon[4:], s)
        return canon[:2] + _iban_check(canon[:2], rest) + rest
    if kind == "person":
        script, gender, name = canon.split("|", 2)
        words = name.split()
        pool, parts = GIVEN[script, gender], SYLLABLES[script]
        family = "".join(parts[s.below(len(parts))] for _ in range(3 + draw // 4)).capitalize()
        given = pool[s.below(len(pool))]
        single = family if words[0] not in _GENDER else given + family.lower()
        return f"{script}|{gender}|" + (f"{given} {family}" if len(words) > 1 else single)
    if kind == "phone":
        return _reshape(canon, s)
    return _reshape(canon, s)


def render(mention: str, kind: str, canon: str) -> str:
    """A surrogate in the form of a mention: its separators, and its letter case for addresses."""
    if kind == "email":
        return canon.upper() if mention.isupper() else canon
    if kind in ("secret", "ip"):
        return canon
    if kind == "person":
        return canon.split("|", 2)[2]
    signs = iter(canon)
    return "".join(next(signs) if c.isalnum() and c.isascii() else c for c in mention)


def mentions(docs: DataFrame) -> DataFrame:
    """row_id, row_text, kind and canonical form of the distinct entities of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, canons = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for kind, canon in sorted({(k, c) for _, _, k, c in detect(text or "")}):
                    at.append(i)
                    kinds.append(kind)
                    canons.append(canon)
            where = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("row_id").take(where), batch.column("row_text").take(where), pa.array(kinds, pa.string()), pa.array(canons, pa.string())],
                                             names=["row_id", "row_text", "kind", "canon"])

    return _keyed(docs).select("row_id", "row_text", "text").mapInArrow(run, "row_id long, row_text long, kind string, canon string")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("row_id"), F.xxhash64("text").alias("row_text"), "text")


def _drawn(entities: DataFrame, key: bytes, draw: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogate(k, c, key, draw) for k, c in zip(batch.column("kind").to_pylist(), batch.column("canon").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("canon"), pa.array(made, pa.string()), pa.array([draw] * len(made), pa.int32())], names=["kind", "canon", "surrogate", "draw"])

    return entities.select("kind", "canon").mapInArrow(run, "kind string, canon string, surrogate string, draw int")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, canon, surrogate of distinct entities (kind, canon): no two share a surrogate, none is a real entity.

    Of entities that collide the one drawn earliest, then the smallest, keeps its surrogate.
    """
    entities = stored(entities)
    fixed, open_, draw = None, entities, 0
    while True:
        if draw > MAX_DRAWS:
            raise RuntimeError("a format has fewer values than entities")
        fresh = stored(_drawn(open_, key, draw))
        state = fresh if fixed is None else fixed.unionByName(fresh)
        owner = state.groupBy("kind", "surrogate").agg(F.min(F.struct("draw", "canon")).alias("first"))
        real = entities.select(F.col("kind"), F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
        judged = stored(state.join(owner, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
                        .select("kind", "canon", "surrogate", "draw", ((F.col("first.canon") == F.col("canon")) & F.col("real").isNull()).alias("free")))
        fixed, open_ = judged.where("free").drop("free"), judged.where("not free")
        if open_.isEmpty():
            return fixed.select("kind", "canon", "surrogate")
        draw += 1


def replace_entities(docs: DataFrame, key: bytes | str) -> DataFrame:
    """doc_id, text with every entity replaced, and n_replaced for every row of ``docs``.

    A null text stays null. Rows that share a doc_id, or have none, keep apart by their
    texts. Other columns are ignored; an empty table gives no rows. The same key, and only
    it, gives the same surrogates for the same corpus.
    """
    key = key.encode() if isinstance(key, str) else key
    found = stored(mentions(docs))
    names = stored(assign(found.select("kind", "canon").distinct(), key))
    # An entity of very many documents meets one row; the shuffle can be split.
    met = found.distinct().join(names, ["kind", "canon"])
    per_row = met.groupBy("row_id", "row_text").agg(F.collect_list(F.struct("kind", "canon", "surrogate")).alias("names"))
    keyed = _keyed(docs).alias("d")
    joined = keyed.join(per_row.alias("n"), F.col("d.row_id").eqNullSafe(F.col("n.row_id")) & (F.col("d.row_text") == F.col("n.row_text")), "left").select("d.row_id", "d.text", "n.names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, known in zip(batch.column("text").to_pylist(), batch.column("names").to_pylist()):
                count = 0
                if known:
                    table = {(n["kind"], n["canon"]): n["surrogate"] for n in known}
                    parts, at = [], 0
                    for a, b, kind, canon in detect(text):
                        parts += [text[at:a], render(text[a:b], kind, table[kind, canon])]
                        at = b
                        count += 1
                    text = "".join([*parts, text[at:]])
                texts.append(text)
                counts.append(count)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["doc_id", "text", "n_replaced"])

    return joined.mapInArrow(run, "doc_id long, text string, n_replaced long")
