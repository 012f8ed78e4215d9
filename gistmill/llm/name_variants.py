"""Variant spellings of names: a noisy channel from canonical forms to what people typed.

Every observation is a display name, an address, or both. Forms that mail systems assigned (``given.surname`` before the at
sign) and full typed names are ranked by how often they occur; they are the candidate canonical forms, and their
frequency is the prior. Each other form is attached to the candidate with the greatest posterior: prior times the likelihood of a
nickname (learned from addresses whose owner is shown under another given name), of a typing error (one edit of the whole
name; candidates come from the neighbourhoods of single deletions, not from pairs), and of an abbreviation (an initial).
Firms are attached to their domain in the same way, without legal forms.

What is one address is one person, unless the part before the at sign names a role. People of the same name at two firms
are different; a domain most of whose owners also have an address elsewhere is a private one and adds no person. Defined results:
observations without name and address, and names that could be nobody in particular, stay alone; NULL is ``""``; repeated
``obs_id`` count once; empty tables give no pair. Blocks are joined by key; pairs are made only inside an entity, as the
result asks for.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.sources.tables import staged

# Words that only firms have in their names, and words before the at sign that name a role.
FIRM_WORDS = set("ltd limited inc incorporated corp corporation gmbh co kg ag sa sas sarl sl srl spa bv nv plc pty llc llp lp sp zoo oo oy ab as aps group grp partners services systems engineering engineers contractors contractor consulting consultants construction constr constructions geotechnical geotech surveying mechanical electrical civil facade university council authority department ministry bank insurance logistics holding holdings company associates solutions technologies industries alliance joint venture jv control team office surv ptnrs mech serv svcs eng engrs elec contr civ cons sys geo tech const bldg".split())
ROLES = set("info documents document docs doccontrol documentcontrol office admin administration contact mail post accounts accounting enquiries enquiry tender tenders projects project support sales hr noreply no-reply donotreply reception helpdesk hello team service invoices billing".split())
LETTERS = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "đ": "d", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ı": "i"})


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().translate(LETTERS)) if not unicodedata.combining(c))


def parse(display: str, domain: str = "") -> tuple[str, str, str]:
    """(kind, given, surname): ``person``, ``firm`` (its first word as given), ``part`` (one word) or ``none``.

    A name that begins like its own domain is a firm's, and one with shortened words.
    """
    text = re.sub(r"\s*\([^()]*\)\s*$", "", display.strip().strip("'\"").strip())
    if not text or "@" in text:
        return "none", "", ""
    tokens = re.findall(r"[^\W\d_]+", fold(re.sub(r"(?<=[^\W\d_A-ZÀ-Þ])(?=[A-ZÀ-Þ][a-zß-ÿ])", " ", text)))
    if any(t in FIRM_WORDS for t in tokens[1:]) or len(re.findall(r"[^\W\d_]{3,}\.", text)) > 1 or len(tokens) > 1 and tokens[0] == re.split("[.-]", domain)[0]:
        return "firm", tokens[0], ""
    if "," in text:
        last, _, first = text.partition(",")
        tokens = re.findall(r"[^\W\d_]+", fold(first)) + ["".join(re.findall(r"[^\W\d_]+", fold(last)))]
    elif re.match(r"^[A-ZÀ-Þ'-]{3,} [A-ZÀ-Þ][a-zß-ÿ]", text):
        tokens = tokens[1:] + tokens[:1]
    tokens = [t for k, t in enumerate(tokens) if len(t) > 1 or k == 0]
    if len(tokens) < 2:
        return ("part", "".join(tokens), "") if tokens else ("none", "", "")
    return "person", "".join(tokens[:-1]), tokens[-1]


def parsed(observations: DataFrame) -> DataFrame:
    """``obs_id, address, domain, role, kind, given, surname, l_given, l_surname, l_initial`` of each observation."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, display, email in zip(frame.obs_id, frame.display.fillna(""), frame.email.fillna("")):
                address = fold(email.strip())
                local, _, domain = address.partition("@")
                kind, given, surname = parse(display, domain)
                role = bool(address) and (re.sub(r"\d+$", "", local) in ROLES)
                l_given = l_surname = l_initial = ""
                if address and not role:
                    if m := re.fullmatch(r"([a-z-]{2,})\.([a-z-]{2,})\d*", local):
                        l_given, l_surname = m[1].replace("-", ""), m[2].replace("-", "")
                    elif m := re.fullmatch(r"([a-z-]{2,})[_.-]([a-z])\d*", local):
                        l_surname, l_initial = m[1].replace("-", ""), m[2]
                    elif m := re.fullmatch(r"([a-z])[_.-]?([a-z-]{2,})\d*", local):
                        l_initial, l_surname = m[1], m[2].replace("-", "")
                rows.append((i, address, domain, role, kind, given, surname, l_given, l_surname, l_initial))
            yield pd.DataFrame(rows, columns=["obs_id", "address", "domain", "role", "kind", "given", "surname", "l_given", "l_surname", "l_initial"])

    kind = observations.schema["obs_id"].dataType.simpleString()
    return observations.select("obs_id", "display", "email").mapInPandas(
        work, f"obs_id {kind}, address string, domain string, role boolean, kind string, given string, surname string, l_given string, l_surname string, l_initial string"
    )


def spelling_counts(emails: DataFrame) -> DataFrame:
    """``display, email, n``: how often each spelling occurs as sender or recipient."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    people = F.concat(
        F.array(F.struct(F.col("sender_name").alias("display"), F.col("sender_email").alias("email"))),
        *[F.coalesce(F.transform(c, lambda p: F.struct(p["display"].alias("display"), p["email"].alias("email"))), F.array().cast("array<struct<display:string,email:string>>")) for c in ("to_list", "cc_list")],
    )
    rows = emails.select(F.explode(people).alias("p")).select(blank(F.col("p.display")).alias("display"), blank(F.col("p.email")).alias("email"))
    return rows.groupBy("display", "email").agg(F.count(F.lit(1)).alias("n"))


def _deletions(name: Column) -> Column:
    """A name and every form of it that lacks one letter: names one edit apart share one of these."""
    return F.array_distinct(F.concat(F.array(name), F.transform(F.sequence(F.lit(1), F.length(name)), lambda k: F.concat(name.substr(F.lit(1), k - 1), name.substr(k + 1, F.length(name))))))


def _grown(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the spellings: never broadcast, as sizes guessed from compressed files mislead."""
    return df.hint("merge")


def entities(observations: DataFrame, emails: DataFrame) -> DataFrame:
    """``obs_id, entity`` of every observation that means a person or a firm."""
    blank = {"display": "", "email": ""}
    base = observations.select("obs_id", "display", "email").na.fill(blank).dropDuplicates(["obs_id"])
    counted = base.join(_grown(spelling_counts(emails)), ["display", "email"], "left").select("obs_id", F.coalesce("n", F.lit(1)).alias("n"))
    obs = staged(parsed(base).join(_grown(counted), "obs_id"), "names-parsed")

    # candidate canonical forms with a domain, from assigned addresses
    owned = obs.where("l_given != ''").groupBy(F.col("l_given").alias("c_given"), F.col("l_surname").alias("c_surname"), F.col("domain").alias("c_domain")).agg(F.sum("n").alias("c_n"))
    homes = Window.partitionBy("c_given", "c_surname")
    owned = staged(owned.withColumn("homes", F.count(F.lit(1)).over(homes)), "names-owned")
    # private: most of its owners also have an address at some firm, at many different ones, and it has no role address
    elsewhere = owned.select("c_given", "c_surname", F.col("c_domain").alias("other"))
    partners = owned.join(_grown(elsewhere), ["c_given", "c_surname"]).where("other != c_domain").groupBy("c_domain").agg(F.countDistinct("other").alias("partners"))
    with_roles = obs.where("role").select(F.col("domain").alias("c_domain")).distinct()
    private = owned.groupBy("c_domain").agg(F.avg((F.col("homes") > 1).cast("double")).alias("shared"), F.count(F.lit(1)).alias("m")).join(_grown(partners), "c_domain")
    private = private.where("shared > 0.5 and m > 3 and partners > 0.3 * m").join(with_roles, "c_domain", "left_anti").select(F.col("c_domain").alias("p_domain"))
    private = staged(private, "names-private")
    owned = owned.join(_grown(private), F.col("c_domain") == F.col("p_domain"), "left").withColumn("is_private", F.col("p_domain").isNotNull())
    # someone with private addresses only is known by the name alone
    firm_homes = F.sum((~F.col("is_private")).cast("int")).over(homes)
    owned = owned.withColumn("firm_homes", firm_homes).where("not is_private or firm_homes = 0").withColumn("c_domain", F.when(F.col("is_private"), "").otherwise(F.col("c_domain")))
    owned = owned.groupBy("c_given", "c_surname", "c_domain").agg(F.sum("c_n").alias("c_n"))
    # names that are typed in full but never assigned: also candidates, with what is known of their domain
    typed = obs.where("kind = 'person' and length(given) > 1 and l_given = ''").join(_grown(private), F.col("domain") == F.col("p_domain"), "left")
    typed = typed.groupBy(F.col("given").alias("c_given"), F.col("surname").alias("c_surname"), F.when(F.col("p_domain").isNull(), F.col("domain")).otherwise("").alias("c_domain")).agg(F.sum("n").alias("c_n"))
    typed = typed.join(_grown(owned.select("c_given", "c_surname").distinct()), ["c_given", "c_surname"], "left_anti")
    forms = staged(owned.withColumn("assigned", F.lit(True)).unionByName(typed.withColumn("assigned", F.lit(False))), "names-forms")

    # nicknames, learned from the owners of assigned addresses
    shown = obs.where("kind = 'person' and l_given != '' and surname = l_surname and given != l_given and length(given) > 1")
    nick = shown.groupBy(F.col("given").alias("nick"), F.col("l_given").alias("nick_of")).agg(F.countDistinct("address").alias("k")).where((F.col("k") > 1) & (F.levenshtein("nick", "nick_of") > 1))
    nick = staged(nick.withColumn("p_nick", F.col("k") / F.sum("k").over(Window.partitionBy("nick"))), "names-nick")

    # what is to be attached: every name that is not settled by an assigned address at a firm
    asks = obs.select("obs_id", "address", "n", "role", "l_initial",
        F.when(F.col("l_given") != "", F.col("l_given")).when(F.col("kind") == "person", F.col("given")).when(F.col("l_initial") != "", F.col("l_initial")).alias("q_given"),
        F.when(F.col("l_given") != "", F.col("l_surname")).when(F.col("kind") == "person", F.col("surname")).when(F.col("l_initial") != "", F.col("l_surname")).alias("q_surname"),
        F.col("domain"), F.col("l_surname"),
    ).where("q_surname is not null").join(_grown(private), F.col("domain") == F.col("p_domain"), "left")
    asks = staged(asks.withColumn("q_domain", F.when(F.col("p_domain").isNull(), F.col("domain")).otherwise("")).drop("p_domain", "domain"), "names-asks")
    forms_asked = asks.groupBy("q_given", "q_surname", "q_domain", "l_initial", "l_surname").agg(F.sum("n").alias("q_n"))
    forms_asked = staged(forms_asked, "names-forms-asked")
    own_domain = (F.col("q_domain") == "") | (F.col("c_domain") == F.col("q_domain")) | (F.col("c_domain") == "")
    asked = ["q_given", "q_surname", "q_domain", "l_initial", "l_surname"]

    def scored(pairs: DataFrame, likelihood: Column) -> DataFrame:
        return pairs.where(own_domain).select(*asked, "c_given", "c_surname", "c_domain", "c_n", "assigned", likelihood.alias("p"))

    exact = scored(forms_asked.join(_grown(forms), (F.col("q_given") == F.col("c_given")) & (F.col("q_surname") == F.col("c_surname"))), F.lit(1.0))
    # one edit: the neighbourhoods of single deletions meet; never by broadcast, as the size before the explosion misleads
    q_keys = forms_asked.where("length(q_given) > 1").select(*asked, F.explode(_deletions(F.concat_ws(" ", "q_given", "q_surname"))).alias("key"))
    c_keys = forms.where("c_n > 1 or assigned").select("c_given", "c_surname", "c_domain", "c_n", "assigned", F.explode(_deletions(F.concat_ws(" ", "c_given", "c_surname"))).alias("key"))
    edits = F.levenshtein(F.concat_ws(" ", "q_given", "q_surname"), F.concat_ws(" ", "c_given", "c_surname"))
    typos = scored(q_keys.join(c_keys.hint("merge"), "key").where(edits.between(1, 2)), F.lit(0.05) * F.pow(F.lit(0.4), edits - 1)).distinct()
    nicks = scored(
        forms_asked.join(_grown(nick), F.col("q_given") == F.col("nick")).join(_grown(forms), (F.col("nick_of") == F.col("c_given")) & (F.col("q_surname") == F.col("c_surname"))), F.lit(0.05) * F.col("p_nick")
    )
    # an initial, written or in an address, with the surname as written or as in the address, at the same firm
    initial = F.when(F.col("l_initial") != "", F.col("l_initial")).when(F.length("q_given") == 1, F.col("q_given"))
    family = F.when(F.col("l_initial") != "", F.col("l_surname")).otherwise(F.col("q_surname"))
    at_firm = forms_asked.withColumns({"initial": initial, "family": family}).where("initial is not null and q_domain != ''")
    by_initial = scored(
        at_firm.join(_grown(forms.withColumn("c_initial", F.substring("c_given", 1, 1))), (F.col("q_domain") == F.col("c_domain")) & (F.col("family") == F.col("c_surname")) & (F.col("initial") == F.col("c_initial"))),
        F.when((F.length("q_given") == 1) | F.col("c_given").startswith(F.col("q_given")) | (F.levenshtein("q_given", "c_given") <= 2), 0.05).otherwise(0.015),
    )
    written_initial = forms_asked.where("length(q_given) = 1 and l_initial = ''")
    bare_initial = scored(
        written_initial.where("q_domain != ''").join(_grown(forms.withColumn("c_initial", F.substring("c_given", 1, 1))), (F.col("q_surname") == F.col("c_surname")) & (F.col("q_given") == F.col("c_initial"))), F.lit(0.02)
    )
    options = exact.unionByName(typos).unionByName(nicks).unionByName(by_initial).unionByName(bare_initial)
    # the prior: how often a form occurs; one that was assigned is no slip
    posterior = F.log("p") + F.log(F.when(F.col("assigned"), F.col("c_n") + 20).otherwise(F.col("c_n") * 0.1)) + F.when(F.col("c_domain") == F.col("q_domain"), 0.7).otherwise(0.0)
    best = options.groupBy(*asked).agg(F.max(F.struct(posterior.alias("score"), "c_given", "c_surname", "c_domain")).alias("b"))
    name_of = lambda g, s, d: F.concat(F.lit("person "), g, F.lit(" "), s, F.lit("@"), d)
    linked = staged(best.select(*asked, "b.score", name_of(F.col("b.c_given"), F.col("b.c_surname"), F.col("b.c_domain")).alias("to")), "names-linked")
    # a typed form that itself was taken for a slip leads on to what that was attached to
    again = linked.where("l_initial = ''").select(name_of(F.col("q_given"), F.col("q_surname"), F.col("q_domain")).alias("from"), F.col("to").alias("next")).where(F.col("from") != F.col("next")).groupBy("from").agg(F.min("next").alias("next"))
    linked = linked.join(_grown(again), F.col("to") == F.col("from"), "left").select(*asked, "score", F.coalesce("next", "to").alias("to"))
    person_of = staged(asks.join(_grown(linked), asked).select("obs_id", "address", "role", "n", "to", "score"), "names-persons")
    # one address, one person: the target with the greatest total posterior
    votes = person_of.where("address != '' and not role").groupBy("address", "to").agg(F.sum("n").alias("votes"), F.max("score").alias("score"))
    owner = votes.groupBy("address").agg(F.max_by("to", F.struct("votes", "score", "to")).alias("owner"))

    label = F.regexp_extract("domain", r"^([^.-]+)", 1)
    firms = obs.where("kind = 'firm' or (role and kind in ('none', 'part'))")
    labels = obs.where("role and domain != ''").select(label.alias("label")).distinct()
    bare = firms.where("domain = ''").select("obs_id", F.col("given").alias("first"))
    meets = bare.select("obs_id", "first", F.explode(_deletions(F.col("first"))).alias("key")).join(labels.select("label", F.explode(_deletions(F.col("label"))).alias("key")).hint("merge"), "key")
    meets = meets.withColumn("d", F.levenshtein("first", "label")).where("d <= 2").groupBy("obs_id").agg(F.min(F.struct("d", "label")).alias("m"))
    firm_of = bare.join(_grown(meets), "obs_id", "left").select("obs_id", F.concat(F.lit("firm "), F.coalesce("m.label", "first")).alias("entity"))
    firm_of = staged(firm_of.unionByName(firms.where("domain != ''").select("obs_id", F.concat(F.lit("firm "), label).alias("entity"))), "names-firms")

    people = obs.join(_grown(firm_of.select("obs_id")), "obs_id", "left_anti").join(_grown(owner), "address", "left").join(_grown(person_of.select("obs_id", "to")), "obs_id", "left")
    # someone's own address settles it; without one, the name
    settled = F.when(F.col("address") != "", F.when(F.col("role"), F.col("to")).otherwise(F.coalesce("owner", F.concat(F.lit("address "), F.col("address"))))).otherwise(F.col("to"))
    return people.select("obs_id", settled.alias("entity")).where("entity is not null").unionByName(firm_of)


def same_entity_pairs(observations: DataFrame, emails: DataFrame) -> DataFrame:
    """``obs_id_a, obs_id_b`` of all observations that mean the same; a < b."""
    known = staged(entities(observations, emails), "names-entities")
    left, right = known.select("entity", F.col("obs_id").alias("obs_id_a")), known.select("entity", F.col("obs_id").alias("obs_id_b"))
    return left.join(_grown(right), "entity").where("obs_id_a < obs_id_b").select("obs_id_a", "obs_id_b")
