"""Ontologies as triples: terms, properties, hierarchies, search and classification.

An ontology is small beside the data, but nothing here gathers it: each operator is a DataFrame of joins and
aggregates over terms.TRIPLES, closures go by semi-naive rounds that end on cycles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semloom import functions as S
from semloom.session import checkpoint, small
from semloom.terms import DC, DCT, HOME, OWL, PREFIXES, RDF, RDFS, SKOS, TRIPLE_COLUMNS

CLASSES = (f"{OWL}Class", f"{RDFS}Class")
LABELS = (f"{SKOS}prefLabel", f"{SKOS}altLabel", f"{SKOS}hiddenLabel", f"{RDFS}label", f"{RDFS}comment", f"{DCT}subject", f"{DC}subject")


def classes(onto: DataFrame) -> DataFrame:
    """(iri) of the classes."""
    return onto.where((F.col("p") == f"{RDF}type") & F.col("o").isin(*CLASSES)).select(F.col("s").alias("iri")).distinct()


def terms(onto: DataFrame, home: str = HOME) -> DataFrame:
    """(iri, label, rank, definition, stage) of every OWL class and label, alternative labels before others."""
    owl = onto.where((F.col("p") == f"{RDF}type") & (F.col("o") == f"{OWL}Class")).select("s").distinct()
    of = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    facts = onto.join(owl, "s", "left_semi").groupBy("s").agg(of(f"{SKOS}definition").alias("definition"), of(f"{home}hasStudyStage").alias("stage"), F.array_sort(F.collect_set(F.when(F.col("p").isin(f"{SKOS}altLabel", f"{RDFS}label"), F.struct(F.when(F.col("p") == f"{SKOS}altLabel", 0).otherwise(1).alias("kind"), F.col("o").alias("label"))))).alias("names"))
    out = facts.select(F.col("s").alias("iri"), "definition", "stage", F.posexplode("names").alias("rank", "n"))
    return out.select("iri", F.col("n.label").alias("label"), "rank", F.coalesce("definition", F.lit("")).alias("definition"), "stage")


def properties(onto: DataFrame) -> DataFrame:
    """(label, iri, kind) of the labelled object and datatype properties; where both have a label, the datatype one."""
    kind = F.when(F.col("o") == f"{OWL}ObjectProperty", 0).when(F.col("o") == f"{OWL}DatatypeProperty", 1)
    typed = onto.where(F.col("p") == f"{RDF}type").select("s", kind.alias("k")).where("k is not null")
    named = onto.where(F.col("p") == f"{RDFS}label").select("s", F.col("o").alias("label"))
    best = typed.join(named, "s").groupBy("label").agg(F.max_by("s", F.struct("k", "s")).alias("iri"), F.max("k").alias("k"))
    return best.select("label", "iri", F.when(F.col("k") == 1, "datatype").otherwise("object").alias("kind"))


def closure(edges: DataFrame, reflexive: bool = True) -> DataFrame:
    """(child, ancestor, depth) reachable over edges (child, parent); depth is the shortest way, 0 for a node itself
    (reflexive). Each round joins only what the last one found, so cycles end, however deep the hierarchy is; rounds are
    checkpointed."""
    edges = checkpoint(edges.select("child", "parent").where("child is not null and parent is not null").distinct())
    nodes = edges.select("child").union(edges.select("parent")).distinct()
    start = nodes.select("child", F.col("child").alias("ancestor"), F.lit(0).alias("depth"))
    known = frontier = checkpoint(start)
    for depth in count(1):
        step = frontier.join(edges.select(F.col("child").alias("ancestor"), "parent"), "ancestor").select("child", F.col("parent").alias("ancestor")).distinct()
        new = checkpoint(step.join(known, ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        known, frontier = checkpoint(known.union(new)), new
    return known if reflexive else known.where("depth > 0")


def superclasses(onto: DataFrame) -> DataFrame:
    """closure() of the subclass edges between named classes."""
    return closure(subclass_edges(onto))


def subclass_edges(onto: DataFrame) -> DataFrame:
    return onto.where((F.col("p") == f"{RDFS}subClassOf") & (F.col("o_kind") == "iri")).select(F.col("s").alias("child"), F.col("o").alias("parent")).distinct()


def root_domains(edges: DataFrame, top: str = f"{OWL}Class") -> DataFrame:
    """(child, root): where climbing the first parent (the least IRI) ends, before `top`. On a cycle it ends at the
    node that is furthest, the least of equal ones."""
    first = edges.where(F.col("parent") != top).groupBy("child").agg(F.min("parent").alias("parent"))
    reach = closure(first)
    return reach.groupBy("child").agg(F.max_by("ancestor", F.struct("depth", F.hex("ancestor"))).alias("root"))


def domain_map(edges: DataFrame) -> DataFrame:
    """(domain, subdomains): each root with the nodes right below it, sorted."""
    roots = root_domains(edges).where("child = root").select(F.col("root").alias("domain"))
    below = edges.join(roots.withColumnRenamed("domain", "parent"), "parent").where("child <> parent")
    return roots.join(below.groupBy(F.col("parent").alias("domain")).agg(F.array_sort(F.collect_set("child")).alias("subdomains")), "domain", "left")


def tree_text(domains: DataFrame) -> str:
    """domain_map() as an indented tree; gathers the map, which is a page of text."""
    lines = []
    for r in domains.orderBy("domain").collect():
        subs = r["subdomains"] or []
        lines.append(r["domain"])
        lines += [f"{'└──' if i == len(subs) - 1 else '├──'} {s}" for i, s in enumerate(subs)]
    return "\n".join(lines)


def term_filter(onto: DataFrame, query: str | None = None, kinds: Sequence[str] = ("domain", "subdomain", "stage"), home: str = HOME) -> DataFrame:
    """(iri) of the terms in a domain, a subdomain or a study stage. A query matches labels whatever their case, and
    local names; a domain holds what its subdomains hold. No query: all terms that have any of the kinds."""
    want = None if query is None else query.strip().lower()
    named = onto.where(F.col("p").isin(f"{RDFS}label", f"{SKOS}altLabel", f"{SKOS}prefLabel")).select(F.col("s").alias("iri"), F.lower("o").alias("label"))
    parts = []
    in_domain = onto.where(F.col("p").isin(f"{home}inDomain", f"{home}hasDomain")).select(F.col("s").alias("iri"), F.col("o").alias("target"))
    in_sub = onto.where(F.col("p").isin(f"{home}inSubDomain", f"{home}hasSubDomain")).select(F.col("s").alias("iri"), F.col("o").alias("target"))
    stage = onto.where(F.col("p") == f"{home}hasStudyStage").select(F.col("s").alias("iri"), F.lower("o").alias("target"))

    def hits(pairs: DataFrame, down: bool) -> DataFrame:
        if want is None:
            return pairs.select("iri")
        all_targets = pairs.select("target").distinct()
        found = all_targets.where(F.lower(S.fragment("target")) == want).unionByName(all_targets.join(named.where(F.col("label") == want).select(F.col("iri").alias("target")), "target", "left_semi")).distinct()
        if down:
            below = onto.where(F.col("p") == f"{RDFS}subClassOf").select(F.col("s").alias("below"), F.col("o").alias("target"))
            found = found.union(below.join(found, "target", "left_semi").select("below")).distinct()
        return pairs.join(found, "target", "left_semi").select("iri")

    if "domain" in kinds:
        parts.append(hits(in_domain, True))
    if "subdomain" in kinds:
        parts.append(hits(in_sub, False))
    if "stage" in kinds:
        parts.append((stage if want is None else stage.where(F.col("target") == want)).select("iri"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def subset(onto: DataFrame, iris: DataFrame) -> DataFrame:
    """The triples of the given subjects."""
    return onto.join(small(iris.select(F.col("iri").alias("s"))), "s", "left_semi").select(*TRIPLE_COLUMNS)


def by_subdomain(onto: DataFrame, home: str = HOME) -> DataFrame:
    """Triples of each term with its (domain, subdomain), for a partitioned write; terms without either don't come."""
    of = lambda p, n: onto.where(F.col("p") == f"{home}{p}").select("s", S.fragment("o").alias(n)).distinct()
    return onto.join(of("inDomain", "domain"), "s").join(of("inSubDomain", "subdomain"), "s").select("domain", "subdomain", *TRIPLE_COLUMNS)


def catalogue(onto: DataFrame) -> DataFrame:
    """(subject_id, label, info): each IRI subject, its label (by the order of LABELS, then the least) and all else as
    "predicate → object", sorted and joined by " | "."""
    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(LABELS))):
        rank = F.when(F.col("p") == p, i).otherwise(rank)
    fact = F.concat(S.fragment("p"), F.lit(" → "), "o")
    out = onto.where(~F.col("s").startswith("_:")).withColumn("rank", rank).groupBy("s").agg(F.min_by("o", F.when(F.col("rank").isNotNull(), F.struct("rank", "o"))).alias("label"), F.array_join(F.array_sort(F.collect_set(fact)), " | ").alias("info"))
    return out.select(F.col("s").alias("subject_id"), "label", "info")


def fuzzy_search(found: DataFrame, keywords: Sequence[str], column: str = "label", distance: int | None = None) -> DataFrame:
    """Rows of a catalogue near any of the keywords, with the first of them that hits as `keyword`; a row once."""
    hit = F.lit(None).cast("string")
    for k in reversed(list(keywords)):
        hit = F.when(S.near_match(column, k, distance), F.lit(k)).otherwise(hit)
    return found.withColumn("keyword", hit).where("keyword is not null")


# --- leaves, tops, classification


def leaf_classes(onto: DataFrame, namespace: str = "") -> DataFrame:
    """(iri) of the classes in subclass edges of the namespace that nothing is below."""
    e = subclass_edges(onto)
    child, parent = e.select(F.col("child").alias("iri")), e.select(F.col("parent").alias("iri"))
    return child.union(parent).where(F.col("iri").startswith(namespace)).distinct().join(parent.distinct(), "iri", "left_anti")


def top_categories(onto: DataFrame, namespace: str = "") -> DataFrame:
    """(iri) of the concepts that are broader than some and narrower than none; where there are none, the namespace's
    classes that aren't narrower than any."""
    e = onto.where((F.col("p") == f"{SKOS}broader") & (F.col("o_kind") == "iri"))
    broad, narrow = e.select(F.col("o").alias("iri")).distinct(), e.select(F.col("s").alias("iri")).distinct()
    top = broad.join(narrow, "iri", "left_anti").withColumn("way", F.lit(0))
    rest = classes(onto).where(F.col("iri").startswith(namespace)).join(narrow, "iri", "left_anti").withColumn("way", F.lit(1))
    both = top.union(rest)
    least = F.min("way").over(Window.partitionBy(F.lit(1)))  # of an ontology's classes: a few thousand rows
    return both.withColumn("least", least).where("way = least").select("iri")


def classify_leaves(onto: DataFrame, leaves: DataFrame, tops: DataFrame) -> DataFrame:
    """(iri, top) of every leaf: the top that a walk over subclass edges, then broader ones, first meets, or null. The
    walk goes depth first by (kind of edge, IRI) and comes to a node once, by the way that is first in that order.

    First the nodes from which a top can be reached are found, upwards from the tops. From a leaf, the first step towards
    such a node is then always right, but for nodes that the walk has been at: a step that only leads back to them isn't
    one, so each leaf carries its walk along, a row a leaf, and steps back where it is stuck."""
    kind = F.when(F.col("p") == f"{RDFS}subClassOf", "0").when(F.col("p") == f"{SKOS}broader", "1")
    edges = checkpoint(onto.where((F.col("o_kind") == "iri") & kind.isNotNull()).select(F.col("s").alias("at"), F.concat(kind, "o").alias("step"), F.col("o").alias("next")).distinct())
    ends = checkpoint(tops.select(F.col("iri").alias("at")).distinct())
    live = frontier = ends
    while not frontier.isEmpty():
        found = edges.join(frontier.withColumnRenamed("at", "next"), "next", "left_semi").select("at").distinct()
        frontier = checkpoint(found.join(live, "at", "left_anti"))
        live = checkpoint(live.union(frontier))
    # a node's steps towards tops, in order; a top has none
    steps = edges.join(live.withColumnRenamed("at", "next"), "next", "left_semi").join(ends, "at", "left_anti")
    steps = checkpoint(steps.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("step", "next"))).alias("steps")))
    walk = checkpoint(leaves.select("iri", F.array("iri").alias("way"), F.array("iri").alias("been")).distinct())
    done = None
    while not walk.isEmpty():
        at = walk.withColumn("at", F.element_at("way", -1))
        hit = checkpoint(at.join(ends, "at", "left_semi").select("iri", F.col("at").alias("top")))
        done = hit if done is None else done.union(hit)
        on = at.join(ends, "at", "left_anti").join(steps, "at", "left")
        on = on.withColumn("next", F.get(F.filter(F.coalesce("steps", F.array()), lambda x: ~F.array_contains("been", x["next"])), F.lit(0))["next"])
        back = F.slice("way", F.lit(1), F.size("way") - 1)
        way = F.when(F.col("next").isNull(), back).otherwise(F.concat("way", F.array("next")))
        been = F.when(F.col("next").isNull(), F.col("been")).otherwise(F.concat("been", F.array("next")))
        walk = checkpoint(on.select("iri", way.alias("way"), been.alias("been")).where(F.size("way") > 0))
    out = leaves.select("iri").distinct()
    return out.withColumn("top", F.lit(None).cast("string")) if done is None else out.join(done, "iri", "left")


def classification(low: DataFrame, combined: DataFrame, namespace: str = "", bindings: Mapping[str, str] = PREFIXES) -> DataFrame:
    """(term, category) of the lower ontology's leaves by the combined one's tops, both as prefixed names."""
    found = classify_leaves(combined, leaf_classes(low, namespace), top_categories(combined, namespace))
    return found.select(S.prefixed_name("iri", bindings).alias("term"), S.prefixed_name("top", bindings).alias("category"))


PALETTE = tuple("FFB3BA BAE1FF BAFFC9 FFFFBA FFDFBA E0BBE4 C7CEEA D5F4E6 F6D6AD E2F0CB".split())


def category_colours(categories: Sequence[str]) -> dict[str, str]:
    """A colour for each category, in order, around the palette."""
    return {c: PALETTE[i % len(PALETTE)] for i, c in enumerate(categories)}


# --- units and licences

QUDT_SCHEMA = "http://qudt.org/schema/qudt/"


def units(onto: DataFrame) -> DataFrame:
    """(name, label, symbol, ucum_code, conversion_multiplier, description) of all units; an English label before any
    other, descriptions of more than 100 characters cut."""
    of = onto.where((F.col("p") == f"{RDF}type") & F.col("o").isin(f"{QUDT_SCHEMA}Unit", f"{QUDT_SCHEMA}DerivedUnit")).select("s").distinct()
    got = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    label = F.min_by("o", F.when(F.col("p") == f"{RDFS}label", F.struct((~F.coalesce(F.col("o_lang") == "en", F.lit(False))).alias("other"), "o")))
    facts = onto.join(of, "s", "left_semi").groupBy("s").agg(label.alias("label"), *[got(QUDT_SCHEMA + p).alias(n) for p, n in (("symbol", "symbol"), ("ucumCode", "ucum_code"), ("conversionMultiplier", "conversion_multiplier"))], F.coalesce(got(f"{DCT}description"), got(f"{QUDT_SCHEMA}plainTextDescription")).alias("description"))
    return facts.select(S.local_name("s").alias("name"), F.coalesce("label", S.local_name("s")).alias("label"), "symbol", "ucum_code", "conversion_multiplier", S.shorten("description", 100).alias("description"))


def quantity_kinds(onto: DataFrame) -> DataFrame:
    """(kind, units): applicable units of each quantity kind, under its normalised name; of kinds with equal names the
    one whose IRI sorts last counts."""
    by = onto.where(F.col("p") == f"{QUDT_SCHEMA}applicableUnit").groupBy("s").agg(F.array_sort(F.collect_set(S.local_name("o"))).alias("units"))
    return by.groupBy(S.normalize(S.local_name("s")).alias("kind")).agg(F.max_by("units", "s").alias("units"))


def search_licenses(licenses: DataFrame, query: str | Column) -> DataFrame:
    """Rows of (licenseId, name, ..) that hold the query in either, whatever the case."""
    q = F.lower(F.lit(query)) if isinstance(query, str) else F.lower(query)
    return licenses.where(F.lower("licenseId").contains(q) | F.lower("name").contains(q))
