"""Subjects of mail: prefixes of replies and forwards, tags of mail systems, the topic behind them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes that mark a reply, a forward, and an automatic answer, in the languages of the mail systems.
REPLY = "re|aw|antw|antwort|sv|vs|odp|rif|res|ref|réf|r|ответ|отв|回复|答复"
FORWARD = "fw|fwd|wg|tr|rv|enc|pd|i|doorst|vb|vl|пересл|пер|fyi|转发"
AUTOMATIC = "automatic reply|auto-reply|autoreply|auto|out of office|automatische antwort|abwesenheit|abwesend|abwesenheitsnotiz|réponse automatique|absence du bureau|respuesta automática|resposta automática|autoodpowiedź|odpowiedź automatyczna|автоответ|автоматический ответ"
SYSTEM = "accepted|declined|tentative|canceled|cancelled|updated|undeliverable|undelivered|read|delivered|zugesagt|abgelehnt|abgesagt|unzustellbar|gelesen|accepté|refusé|annulé|lu|aceptado|rechazado|cancelado|aceita|cancelada|zaakceptowano|odwołano|принято|отменено"
TAG = r"\[[^\[\]]{1,40}\]|\((?:external|extern|externe)\)|(?:external|extern|externe)\s*:"


def _prefix(words: str) -> str:
    return rf"(?:{words})\s*(?:\[\d+\]|\(\d+\)|\d+)?\s*[:：]"


def clean(subject: Column) -> Column:
    """NULL as empty, white space (also non-breaking) as single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(subject, F.lit("")), r"[\s\x{00A0}\x{200B}]+", " "))


def without_tags(subject: Column) -> Column:
    """A subject without the mail-system tags in front of its first prefix or word."""
    return F.regexp_replace(clean(subject), rf"(?iu)^(?:\s*(?:{TAG}))+\s*", "")


def outermost(subject: Column) -> Column:
    """``reply``, ``forward``, ``automatic`` or ``none``: what the first prefix says."""
    bare = without_tags(subject)
    return (
        F.when(bare.rlike(rf"(?iu)^{_prefix(AUTOMATIC)}"), "automatic")
        .when(bare.rlike(rf"(?iu)^{_prefix(REPLY)}"), "reply")
        .when(bare.rlike(rf"(?iu)^{_prefix(FORWARD)}"), "forward")
        .otherwise("none")
    )


def topic(subject: Column) -> Column:
    """A subject without prefixes and tags, in lower case; empty where nothing is left."""
    strip = rf"(?iu)^(?:\s*(?:{TAG}|{_prefix('|'.join((REPLY, FORWARD, AUTOMATIC, SYSTEM)))}))+\s*"
    return F.lower(F.trim(F.regexp_replace(clean(subject), strip, "")))


def conversation_key(conversation_topic: Column, subject: Column) -> Column:
    """The conversation topic or, if empty, the topic of the subject; in lower case without outer blanks."""
    own = F.lower(clean(conversation_topic))
    return F.when(own != "", own).otherwise(topic(subject))


def bare(subject: Column) -> Column:
    """A subject without any number of prefixes and tags; ``(no subject)`` where nothing is left."""
    strip = rf"(?iu)^(?:\s*(?:{TAG}|{_prefix('|'.join((REPLY, FORWARD, AUTOMATIC, SYSTEM)))}))+\s*"
    text = F.trim(F.regexp_replace(clean(subject), strip, ""))
    return F.when(text == "", "(no subject)").otherwise(text)
