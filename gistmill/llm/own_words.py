"""What the sender of an email wrote: without quoted history, closings, signatures, footers, disclaimers and warnings.

Each body is read line by line first: quote marks, introductions, header blocks, separators, closing formulas with
the block under them, device footers, disclaimers and banners in several languages are marked; what
stands between quoted lines, postscripts, and lines that only look like quotes or headers (a comparison, ``From:``
without a date) is not. Then, per thread, an automaton over the sentences that others wrote in all earlier messages, and over the lines of
the sender's own closing blocks, is run over all of a message, quoted or not: matched intervals are merged, and what
they cover is subtracted. Marks that stand alone decide only where no earlier message shows the text: history that was
never filed, and forms that nobody wrote before.

In lines without a mark a merged interval counts from two different sentences on, as people write single ones like
"Noted." anew, and sentences that other threads have too are forms that people use again, no history; lines of a closing block count
at the end of what is new. A thread is a topic without a silence of more than :data:`DAYS` days. Which sentences a
message shares with earlier ones is found by joining hashes of sentences, so that only these go into automata, and messages
stay spread by ``idx`` however large their thread is.

Defined results: NULL, empty and blank bodies have no lines; repeated rows are read each; messages without topic or
instant are only read by themselves; bodies are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import accumulate, takewhile

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions.subjects import conversation_key
from gistmill.llm.wrong_charset import restore
from gistmill.operators.instants import with_instant
from gistmill.sources.tables import staged

#: Days of silence after which a topic starts a new thread.
DAYS = 21
DAY = 86_400

LONGS = pa.list_(pa.int64())

MARK = re.compile(r"^\s*((?:[>|]\s?)+)")
CLOCK = r"\d{1,2}[:.h]\d{2}"
WROTE = r"(?:wrote|writes|schrieb|schreibt|geschrieben|a .crit|.crivait|escribi.|escreveu|napisa.(?:\(a\)|a)?|pisze|пишет|писал(?:\(а\)|а)?|написал(?:\(а\)|а)?)"
INTRO_TAIL = re.compile(rf"^(?:<[^<>]+@[^<>]+>\s*)?(?:{WROTE})?[^.!?]{{0,60}}[:：]\s*$|^<[^<>]+@[^<>]+>\s*[:：]?\s*$", re.I)
ADDRESS = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+")
# The fields of quoted headers.
FIELDS = {
    "from": "from|von|de|od|от|expéditeur|remitente|da",
    "date": "sent|date|gesendet|datum|envoyé|envoyé le|fecha|enviado|enviado el|enviada|enviada em|data|wysłano|отправлено|дата",
    "to": "to|an|à|para|do|кому",
    "cc": "cc|cci|dw|копия|kopie|copie|c\\.c\\.",
    "subject": "subject|betreff|objet|asunto|assunto|temat|тема",
}
FIELD = {k: re.compile(rf"^[\s*_]*(?:{v})\s*[*_]*\s?[:：][*_]*(?:\s|$)", re.I) for k, v in FIELDS.items()}
SEPARATOR = re.compile(r"^[\s]*(?:-{2,}|\*{2,}|_{2,}|={2,}|—+)\s*(?=[^\W\d_])[^-*_=—]*(?:message|nachricht|forwarded by|weitergeleitet von|transféré par|reenviado por|mensaje|mensagem|wiadomość|сообщение|mail|transféré|messaggio)[^-*_=—]*\s*(?:-{2,}|\*{2,}|_{2,}|={2,}|—+)?\s*$|^\s*(?:begin forwarded message|anfang der weitergeleiteten|début du message|inicio del mensaje|início da mensagem|początek przekazanej|начало пересылаемого)[^:]*:\s*$", re.I)
SEPARATOR_STARTS = tuple("-*_=—bBaAdDiIpPнН")
RULE = re.compile(r"^\s*(?:_{2,}|-{2,}|\*{3,}|={3,}|—{2,})\s*$")
CLOSING = re.compile(
    r"^\s*(?:(?:many |with |very )?(?:kind|best|warm|kindest|warmest) (?:regards|wishes)|regards|best|thanks(?: again| and regards| and kind regards| in advance)?|many thanks(?: and (?:kind |best )?regards)?|thank you|cheers|br|kr|rgds|brgds|yours (?:sincerely|faithfully|truly)|sincerely|all the best|"
    r"mit (?:freundlichen|besten|vielen|herzlichen) grüßen|mit freundlichem gruß|(?:viele|beste|liebe|freundliche|herzliche|schöne) grüße|freundlichen gruß|gruß|grüße|mfg|vg|lg|danke|vielen dank|"
    r"cordialement|bien cordialement|bien à vous|bonne journée|sincères salutations|salutations(?: distinguées)?|merci|cdlt|bien à toi|"
    r"saludos(?: cordiales)?|un (?:cordial )?saludo|atentamente|gracias|un abrazo|"
    r"cumprimentos|melhores cumprimentos|com os melhores cumprimentos|atenciosamente|obrigad[oa]|abraços|"
    r"pozdrawiam|z poważaniem|z wyrazami szacunku|serdecznie pozdrawiam|dziękuję|"
    r"с уважением|спасибо|всего доброго|с наилучшими пожеланиями)\s*[,.!–-]*\s*$",
    re.I,
)
DEVICE = re.compile(r"^\s*(?:sent (?:from|via|with) (?:my|a|the|an|outlook|mail)\b.*|get (?:the|outlook|mail)\b.* (?:app\b.*|for (?:ios|android|tablets|phones|mobile).*)|von unterwegs gesendet.*|(?:gesendet|diese nachricht wurde) (?:von|mit) mein.*|von meinem .* gesendet.*|envoyé (?:depuis|de) mon .*|enviado (?:desde|do|de|a partir do) (?:mi|meu) .*|wysłan[eo] z .*|отправлено (?:с|из) .*)$", re.I)
BANNER = re.compile(r"^\s*(?:\[(?:external|extern|externe|externo|caution)\].{0,40}(?:outside|extern|expéditeur|fuera|remetente|origin).*|(?:caution|warning|achtung|attention|vorsicht|atención|atenção|uwaga|внимание)\s*[:!–-].*(?:extern|outside|attachment|anhäng|pièce|adjunt|anexo|załącznik|вложен|внешн|absender|sender).*|this (?:message|e-?mail) (?:came|originated) from outside.*)$", re.I)
NOTICE = re.compile(
    r"^\s*(?:(?:this (?:e-?mail|message|transmission|communication)|the (?:content|contents|information) (?:of|in|contained in) this|notice:|disclaimer|confidentiality|diese (?:e-?mail|nachricht|mitteilung)|der inhalt dieser|ce (?:message|courriel|mail)|le pr.sent (?:courriel|message)|este (?:mensaje|correo|e-mail)|esta (?:mensagem|comunicación)|esta mensagem|ta wiadomość|niniejsza wiadomość|это (?:сообщение|письмо)|данное (?:сообщение|письмо)|esta e-mail)\b.*"
    r"(?:confiden|privileg|intended|copied|passed on|consent|recipient|addressee|mistake|vertraulich|zustimmung|bestimmt|confidentiel|diffus|destinataire|destinatari|poufn|adresat|конфиденц|адресат|files sent|attachment|anhänge|pièces jointes|adjuntos|anexos|załącznik|вложени|communication)"
    r"|notice: this\b|we accept no liability\b|registered in the district\b|geschäftsführung:|sitz:|please consider the environment\b|any quotation herein\b|think before you print|registered office\b|company registration\b)",
    re.I,
)
CONTACT = re.compile(r"(?:\+\d{1,3}[\s(]|\b(?:tel|phone|mob|mobile|fax|direct)\b\.?\s*[:+]|^\s*[TMFD]\s*[:+]|www\.|https?://|\[cid:|@[\w-]+\.[a-z]|\bpronouns\b|^\s*working days\b|^\s*(?:office hours|arbeitszeiten|horaires)\b)", re.I)
LONE_CONTACT = re.compile(r"^(?:\[cid:|www\.|https?://\S+$|[TMFD]\s*[:+]|tel\.?\s*[:+]|my pronouns\b|working days\b|[\w.+-]+@[\w-]+\.[\w.-]+$)", re.I)
POSTSCRIPT = re.compile(r"^\s*(?:p\.?\s?p?\.?\s?s\.?\b|ps\b|n\.?b\.?\b|p\.?d\.?\b|з\.?\s?ы\.?\b)[\s.:–-]*\S?", re.I)
SENTENCE_END = re.compile(r"[.!?…]\s*$")


# a number with a unit or a span of time behind a mark
COMPARISON = re.compile(r"^>\s?\d+(?:[.,]\d+)?\s?(?:%|°|[kMGm]?(?:Pa|N|W|V|Hz|g|m|l|t|A)\b|[mck]m[²³]?\b|m[²³]|bar\b|dB\b|weeks?\b|days?\b|hours?\b|min|h\b|years?\b|wochen?\b|tagen?\b|stunden?\b|semaines?\b|jours?\b|heures?\b|semanas?\b|d[íi]as?\b|horas?\b|tygodni|dni\b|godzin|недел|дн|час)", re.I)


@lru_cache(maxsize=65_536)
def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if c.isalpha())


@lru_cache(maxsize=65_536)
def _names(name: str | None, email: str | None) -> set[str]:
    """How a sender may sign: letters only."""
    name = re.sub(r"\([^()]*\)|['\"]", " ", name or "")
    found = set()
    if "@" in name:
        name = ""
    if "," in name:
        last, _, first = name.partition(",")
        name = f"{first} {last}"
    words = re.findall(r"[^\W\d_]+", re.sub(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])", " ", name))
    local = re.split(r"[._\d-]+", (email or "").partition("@")[0].lower())
    for parts in (words, [w for w in local if w]):
        parts = [_plain(w) for w in parts if _plain(w)]
        if not parts:
            continue
        found |= {"".join(parts), "".join(parts[::-1]), parts[0], "".join(p[0] for p in parts), "".join(p[0] for p in parts[::-1])}
        if len(parts) > 1:
            found |= {parts[0] + parts[-1], parts[-1] + parts[0], parts[0][0] + parts[-1], parts[0][0] + parts[-1][0], *([parts[-1]] if len(parts[-1]) > 3 else [])}
    return {f for f in found if len(f) > 1}


def _close(a: str, names: set[str]) -> bool:
    """Whether letters are one of the names, or one slip away from a long one."""
    if a in names:
        return True
    return len(a) > 6 and any(abs(len(a) - len(n)) < 2 and n[:2] == a[:2] and sum(x != y for x, y in zip(sorted(a), sorted(n))) <= len(a) // 3 and (a[:4] == n[:4] or a[-4:] == n[-4:]) for n in names if len(n) > 6)


FIELD_LIKE = re.compile(r"^[\s*_]*[^\W\d_][^:：*]{0,14}\*?\s?[:：]")
HAS_WROTE = re.compile(WROTE, re.I)
# One of these stands in every warning, notice or footer, and in every introduction.
NOTICE_WORDS = tuple("extern|outside|copied|passed on|mistake|attachment|confiden|privileg|intended|consent|recipient|addressee|vertraulich|zustimmung|bestimmt|destinat|diffus|poufn|adresat|конфиденц|liability|registered|geschäftsführung|sitz:|environment|quotation|print|notice|disclaimer|absender|sender|files sent|unterwegs|gesendet|envoyé|enviado|wysłan|отправлено|sent |get |anhäng|pièce|adjunto|anexo|załącznik|вложен|communication|attention|caution|warning".split("|"))
WROTE_WORDS = ("wrote", "writes", "schr", "crit", "crivait", "escribi", "escreveu", "napisa", "pisze", "пишет", "исал")


def _any(words: tuple[str, ...], text: str) -> bool:
    return any(w in text for w in words)


def _header_at(lines: list[str], k: int) -> int:
    """The line after a header block that starts at ``k``, or ``k`` if there is none: fields in any order, a date with a number among them."""
    if not FIELD_LIKE.match(lines[k]):
        return k
    seen, dated, at, blanks = set(), False, k, 0
    while at < len(lines) and len(seen) < 6:
        text = lines[at].strip()
        if not text:
            blanks += 1
            if blanks > 1 or not seen:
                break
            at += 1
            continue
        kind = next((f for f, p in FIELD.items() if p.match(text)), None)
        if kind is None or kind in seen:
            break
        blanks = 0
        seen.add(kind)
        dated |= kind == "date" and bool(re.search(r"\d", text))
        at += 1
    return at if dated and len(seen) >= 2 and ({"from", "to", "subject"} & seen) else k


def read_body(body: str, name: str | None, email: str | None) -> tuple[list[int], list[int]]:
    """(numbers of new lines, numbers of lines in the sender's own closing block); lines end at a line feed, from 1."""
    return _read_restored(restore(body)[0], name, email)[:2]


def _read_restored(body: str, name: str | None, email: str | None) -> tuple[list[int], list[int], list[int]]:
    """As :func:`read_body`, of a text as it was written (restoring leaves lines lines), and the numbers of quoted lines."""
    lines = [x.rstrip() for x in body.replace("\r", "").replace("\xa0", " ").split("\n")]
    n = len(lines)
    filled = [k for k in range(n) if lines[k].strip()]
    place = {k: p for p, k in enumerate(filled)}
    kind = [""] * n  # "" new, q quoted, h intro or header, s closing block, f footer
    names = _names(name, email)
    label = _plain(re.split("[.-]", (email or "").rpartition("@")[2])[0])
    marks = [x.lstrip()[:1] in (">", "|") for x in lines]

    def after(k: int, step: int = 1) -> int | None:
        p = place.get(k)
        return filled[p + step] if p is not None and 0 <= p + step < len(filled) else None

    # quoted lines, unless a lone mark is a comparison
    low = body.lower()
    wrote = _any(WROTE_WORDS, low)
    for p, k in enumerate(filled):
        if not marks[k]:
            continue
        alone = not (p and marks[filled[p - 1]]) and not (p + 1 < len(filled) and marks[filled[p + 1]])
        text = lines[k].strip()
        comparison = bool(COMPARISON.match(text))
        table = text.startswith("|") and text.endswith("|") and text.count("|") > 2
        if table or alone and comparison:
            continue
        kind[k] = "q"
    # introductions: one line, or wrapped over up to three, in front of a quoted line
    for p, k in enumerate(filled):
        if kind[k] != "q" or p == 0:
            continue
        b = filled[p - 1]
        if kind[b]:
            continue
        if not wrote:
            continue
        a = b
        text = lines[b].strip()
        for _ in range(3):
            prev = after(a, -1)
            goes_on = prev is not None and not kind[prev] and len(lines[prev]) <= 160 and (not SENTENCE_END.search(lines[prev]) or bool(re.search(r"\b(?:[A-Za-z]|o\.o|Ltd|Inc|Co)\.\s*$", lines[prev])))
            said = HAS_WROTE.search(text)
            if said and (re.search(r"[:：]\s*$", text) or re.search(CLOCK, text)):
                # whole if it names a time and somebody; the rest of it may stand on the line before
                named = text[: said.start()].strip(" ,-–") != "" or ADDRESS.search(text) or re.search(rf"{WROTE}.*{CLOCK}.*|{WROTE} [^\W\d_]", text, re.I) and said.start() > 0
                if re.search(CLOCK, text) and named and not text.startswith("<"):
                    break
                if goes_on and (re.search(CLOCK, lines[prev]) or ADDRESS.search(lines[prev]) or re.search(CLOCK, text)):
                    a = prev
                    text = lines[a].strip() + " " + text
                    continue
                break
            if not goes_on:
                break
            a = prev
            text = lines[a].strip() + " " + text
        if HAS_WROTE.search(text) and (re.search(CLOCK, text) or ADDRESS.search(text)) and (re.search(r"[:：]\s*$", text) or re.search(CLOCK, text)):
            for x in filled[place[a] : p]:
                kind[x] = "h"
    # introductions whose quote is missing
    for k in filled if wrote else ():
        if not kind[k] and len(lines[k]) < 200:
            text, b = lines[k].strip(), after(k)
            if not re.search(r"[:：]$", text) and b is not None and not kind[b] and INTRO_TAIL.match(lines[b].strip()):
                if re.search(WROTE, text + lines[b], re.I) and re.search(CLOCK, text + lines[b]) and not SENTENCE_END.search(text):
                    kind[k] = kind[b] = "h"
            elif re.search(WROTE, text, re.I) and re.search(CLOCK, text) and re.search(r"[:：]$", text):
                kind[k] = "h"
    # header blocks without marks: from there on all is history
    separators = {k for k in filled if lines[k].lstrip()[:1] in SEPARATOR_STARTS and SEPARATOR.match(lines[k])}
    cut = n
    for k in filled:
        if kind[k] == "q":
            continue
        end = _header_at(lines, k)
        if end > k:
            cut = k
            b = after(k, -1)
            while b is not None and (b in separators or RULE.match(lines[b])):
                cut = b
                b = after(b, -1)
            break
        if k in separators and not (after(k) is not None and marks[after(k)]):
            cut = k
            break
    for k in range(cut, n):
        kind[k] = "q"
    for k in separators:
        kind[k] = kind[k] or "h"
    # warnings, notices (to the end of their paragraph) and device footers
    blanks = sum(1 for k in range(n) if not lines[k].strip())
    spaced = blanks >= len(filled) - 1 and len(filled) > 3  # every line is followed by an empty one
    for k in filled if _any(NOTICE_WORDS, low) else ():
        if kind[k]:
            continue
        text = lines[k].strip()
        if BANNER.match(text) or DEVICE.match(text):
            kind[k] = "f"
        elif NOTICE.match(text):
            x = k
            while x is not None and not kind[x] and (x == k or spaced or x - 1 in place):
                if x > k and spaced and (POSTSCRIPT.match(lines[x]) or CLOSING.match(lines[x])):
                    break
                kind[x] = "f"
                x = after(x)
            b = after(k, -1)
            if b is not None and not kind[b] and RULE.match(lines[b]):
                kind[b] = "f"
    # closing formulas and signatures with the block under them
    for p, k in enumerate(filled):
        if kind[k]:
            continue
        text = lines[k].strip()
        if len(text) > 100:
            continue
        letters = _plain(text) if len(text) < 60 else ""

        def under(p: int = p) -> list[int]:
            """What stands under a line, up to the next quote."""
            return [x for x in takewhile(lambda x: kind[x] not in ("q", "h"), filled[p + 1 : p + 9]) if not kind[x]]

        starts = False
        if text in ("__", "—") or text[:2] == "--" and not text[2:].strip():
            starts = True
        elif CLOSING.match(text):
            below = under()
            starts = not below or _close(_plain(lines[below[0]]), names) or len(lines[below[0]]) < 60 and not SENTENCE_END.search(lines[below[0]]) or bool(POSTSCRIPT.match(lines[below[0]]))
        elif letters and text[-1] not in ",:!?" and (_close(letters, names) or len(label) > 4 and label in letters and len(text) < 45):
            below = under()
            starts = not below or any(CONTACT.search(lines[x]) for x in below[:4]) or bool(POSTSCRIPT.match(lines[below[0]])) or all(len(lines[x]) < 40 and not SENTENCE_END.search(lines[x]) for x in below[:2])
        elif len(text) < 60 and LONE_CONTACT.match(text) and CONTACT.search(text) and not SENTENCE_END.search(text):
            starts = True
        if not starts:
            continue
        kind[k] = "s"
        if CONTACT.search(text):  # a block without a formula: names and titles just above belong to it
            x = k - 1
            while x in place and k - x < 6 and not kind[x] and len(lines[x]) < 60 and not re.search(r"[.,:;!?…]\s*$", lines[x]) and lines[x].count("|") < 2 and re.match(r"\s*[^\W\d_a-zß-ÿ]", lines[x]):
                kind[x] = "s"
                x -= 1
        for x in filled[p + 1 :]:
            if kind[x] in ("q", "h"):
                break
            if kind[x]:
                continue
            if POSTSCRIPT.match(lines[x]) or x - 1 not in place and not spaced and len(lines[x]) > 60 and SENTENCE_END.search(lines[x]) and not CONTACT.search(lines[x]):
                break
            kind[x] = "s"
    for k in filled:  # rules that separate what is not new
        if not kind[k] and not lines[k].lstrip()[:1].isalnum() and RULE.match(lines[k]):
            kind[k] = "f"
    return [k + 1 for k in filled if not kind[k]], [k + 1 for k in filled if kind[k] == "s"], [k + 1 for k in filled if kind[k] == "q"]


SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def _hash(text: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(text), "little", signed=True)


def _sentences(lines: list[str]) -> list[str]:
    return SENTENCE.split(" ".join(lines)) if lines else []


def _line_hash(text: str, sender: int) -> int:
    """Lines of closing blocks belong to their sender."""
    return _hash(f"{sender}\n{text}")


def read_bodies(emails: DataFrame) -> DataFrame:
    """``idx, key columns...``, lines as ``own_no, own`` and ``quoted_no, quoted``, and hashes: ``wrote`` and ``shows`` of sentences, ``closes`` and ``ends`` of lines."""
    keep = [c for c in emails.columns if c not in ("body", "sender_name", "sender_email")]
    kinds = {"own_no": "array<int>", "own": "array<string>", "quoted_no": "array<int>", "quoted": "array<string>"} | dict.fromkeys(("wrote", "shows", "closes", "ends"), "array<long>")
    types = [pa.list_(pa.int32()), pa.list_(pa.string())] * 2 + [LONGS] * 4

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[] for _ in types]
            for body, name, email, sender in zip(*[batch.column(c).to_pylist() for c in ("body", "sender_name", "sender_email", "sender")]):
                body = restore(body)[0]  # rules and automata need the text as it was written
                new, closing, old = _read_restored(body, name, email)
                raw = body.split("\n")
                mine = [" ".join(raw[k - 1].split()) for k in new]
                theirs = [" ".join(MARK.sub("", raw[k - 1]).split()) for k in old]
                hashes = [[_hash(x) for x in _sentences(mine)], [_hash(x) for x in _sentences(theirs)], [_line_hash(" ".join(raw[k - 1].split()), sender) for k in closing], [_line_hash(x, sender) for x in mine]]
                for column, value in zip(made, (new, mine, old, theirs, *hashes)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *map(pa.array, made, types)], [*keep, *kinds])

    schema = ", ".join([*[f"{c} {emails.schema[c].dataType.simpleString()}" for c in keep], *[f"{c} {t}" for c, t in kinds.items()]])
    return emails.where(F.col("body").isNotNull()).mapInArrow(read, schema)


def shared(read: DataFrame) -> DataFrame:
    """``idx, thread, shown, said, closing``: hashes of quoted and bare sentences and of lines that earlier messages hold, of each message that has any."""
    dated = read.where("topic != 0 and utc_s is not null").withColumn("day", F.floor(F.col("utc_s") / DAY))
    # threads from the days on which a topic has messages: a topic has few of them, however many messages
    order = Window.partitionBy("topic").orderBy("day")
    days = dated.select("topic", "day").distinct()
    days = days.withColumn("opens", F.coalesce(F.col("day") - F.lag("day").over(order) > DAYS, F.lit(True)))
    days = days.select("topic", "day", F.last(F.when(F.col("opens"), F.xxhash64("topic", "day")), True).over(order).alias("thread"))
    rows = dated.join(days, ["topic", "day"])
    rows = staged(rows.select("idx", "thread", "sender", F.struct("utc_s", "idx").alias("at"), "wrote", "shows", "closes", "ends"), "own-words-threads")
    # of each sentence the first messages of two senders: one of them is not the reader's own
    first = rows.select("thread", "sender", "at", F.explode("wrote").alias("h")).groupBy("thread", "h", "sender").agg(F.min("at").alias("at"))
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("thread", "h").orderBy("at"))).where("k <= 2").select("thread", "h", F.col("sender").alias("writer"), F.col("at").alias("written"))
    asked = F.array_distinct(F.concat(*[F.transform(c, lambda h: F.struct(h.alias("h"), F.lit(marked).alias("marked"))) for c, marked in (("shows", True), ("wrote", False))]))
    asked = rows.select("thread", "idx", "sender", "at", F.explode(asked).alias("s")).select("thread", "idx", "sender", "at", "s.h", "s.marked")
    told = asked.join(first, ["thread", "h"]).where("written < at and writer != sender").select("idx", "thread", "h", "marked")
    told = staged(told.distinct(), "own-words-told")
    only_here = rows.select("thread", F.explode("wrote").alias("h")).groupBy("h").agg(F.min("thread").alias("a"), F.max("thread").alias("b")).where("a = b").select("h")
    blocks = rows.select("thread", "at", F.explode("closes").alias("h")).groupBy("thread", "h").agg(F.min("at").alias("written"))
    closed = rows.select("thread", "idx", "at", F.explode(F.array_distinct("ends")).alias("h")).join(blocks, ["thread", "h"]).where("written < at")
    kinds = {"shown": told.where("marked"), "said": told.where("not marked").join(only_here, "h"), "closing": closed}
    every = reduce(DataFrame.unionByName, [df.select("idx", "thread", "h", F.lit(kind).alias("kind")) for kind, df in kinds.items()])
    return every.groupBy("idx", "thread").agg(*[F.collect_set(F.when(F.col("kind") == kind, F.col("h"))).alias(kind) for kind in kinds])


def _covered(automaton, numbers: list[int], lines: list[str], known: set[int], marked: bool) -> list[int]:
    """Numbers of the lines that merged intervals cover; ``marked``: of quoted lines, where one sentence is enough."""
    text = " ".join(lines)
    spans = [(end - length + 1, end + 1) for end, (length, h) in automaton.iter(text) if h in known]
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1] + 1:
            merged[-1][2] |= text[s:e] != text[merged[-1][0] : e] and text[s:e] not in text[merged[-1][0] : s]
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, marked])
    starts = accumulate(lines, lambda at, line: at + len(line) + 1, initial=0)
    # a line of quoted text may be cut off within a sentence: any part of it tells
    fits = (lambda a, z, s, e: s < z and a < e) if marked else (lambda a, z, s, e: s <= a and z <= e)
    return [k for k, line, a in zip(numbers, lines, starts) if any(several and fits(a, a + len(line), s, e) for s, e, several in merged)]


def history(read: DataFrame) -> DataFrame:
    """``idx, line_no, marked`` of the lines that earlier messages of the thread hold, or the sender's closing blocks; ``marked``: quoted lines."""
    known = shared(read)
    work = read.select("idx", "sender", "own_no", "own", "quoted_no", "quoted").join(known, "idx")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        for batch in batches:
            threads: dict[int, list[tuple]] = {}
            columns = ("thread", "idx", "sender", "closing", "own_no", "own", "said", "quoted_no", "quoted", "shown")
            for thread, idx, sender, closing, own_no, own, said, quoted_no, quoted, shown in zip(*[batch.column(c).to_pylist() for c in columns]):
                threads.setdefault(thread, []).append((idx, sender, set(closing), [(False, own_no, own, set(said)), (True, quoted_no, quoted, set(shown))]))
            out_idx, out_line, out_marked = [], [], []
            for rows in threads.values():
                automaton = ahocorasick.Automaton()
                for *_, parts in rows:
                    for _, _, lines, hashes in parts:
                        for sentence in _sentences(lines) if hashes else ():
                            if sentence and (h := _hash(sentence)) in hashes:
                                automaton.add_word(sentence, (len(sentence), h))
                automaton.make_automaton()
                for idx, sender, closing, parts in rows:
                    for marked, numbers, lines, hashes in parts:
                        hits = set(_covered(automaton, numbers, lines, hashes, marked)) if hashes else set()
                        if not marked and closing:
                            hits |= {k for k, _ in takewhile(lambda x: _line_hash(x[1], sender) in closing, zip(reversed(numbers), reversed(lines)))}
                        out_idx += [idx] * len(hits)
                        out_line += sorted(hits)
                        out_marked += [marked] * len(hits)
            yield pa.RecordBatch.from_arrays([pa.array(out_idx, pa.int64()), pa.array(out_line, pa.int32()), pa.array(out_marked, pa.bool_())], ["idx", "line_no", "marked"])

    return work.mapInArrow(scan, "idx long, line_no int, marked boolean")


def read_emails(emails: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """:func:`read_bodies` of all rows, written to the shared folder."""
    rows = with_instant(emails.select("idx", "mailbox", "date_iso", "body", "sender_name", "sender_email", "subject", "conversation_topic"), mailboxes)
    topic = conversation_key(F.col("conversation_topic"), F.col("subject"))
    rows = rows.select("idx", "utc_s", F.coalesce(F.xxhash64(F.lower(F.trim("sender_email"))), F.lit(0)).alias("sender"), F.when(topic != "", F.xxhash64(topic)).otherwise(0).alias("topic"), "body", "sender_name", "sender_email")
    return staged(read_bodies(rows), "own-words")


def own_lines(emails: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """``idx, line_no`` of each line that the sender of a row wrote."""
    read = read_emails(emails, mailboxes)
    found = read.select("idx", F.explode("own_no").alias("line_no"))
    old = history(read).where("not marked").select("idx", "line_no").distinct()
    return found.join(old, ["idx", "line_no"], "left_anti").select("idx", "line_no")


def lines_taken_off(emails: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """``taken_by, lines``: quoted lines that the automata find in earlier messages, those that only marks show, and lines without a mark that the automata take off."""
    read = read_emails(emails, mailboxes)
    found = staged(history(read).distinct(), "own-words-history")
    marks = read.select(F.sum(F.size("quoted")).alias("n"), F.lit("mark alone").alias("taken_by"))
    by = F.when(F.col("marked"), "mark and earlier message").otherwise("earlier message alone")
    taken = found.groupBy(by.alias("taken_by")).agg(F.count(F.lit(1)).alias("n"))
    less = taken.where("taken_by like 'mark%'").select((-F.col("n")).alias("n"), F.lit("mark alone").alias("taken_by"))
    return marks.unionByName(taken).unionByName(less).groupBy("taken_by").agg(F.sum("n").alias("lines"))
