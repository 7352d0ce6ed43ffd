"""Relation labels from dependency paths.

A path is an array of nodes ``(position, lemma, pos_tag, tag, head, depth)`` from one mention to another; ``tag`` and ``head``
are rewritten, the token's own tag stays in the sentence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.constants import ADJECTIVE, LABEL_SEMTYPES, NOUN, VERB, whole
from spanloom.functions.let import let

NODE = "struct<position:int,lemma:string,pos_tag:string,tag:string,head:int,depth:int>"
#: Nodes a path may have.
LONGEST = 6


def path_nodes(tokens: Column, paths: Column, path: Column) -> Column:
    """Nodes of a path of positions; ``tokens`` in the order of their positions."""
    def node(p: Column, t: Column) -> Column:
        return F.struct(
            p.cast("int").alias("position"), t["lemma"].alias("lemma"), t["pos_tag"].alias("pos_tag"), t["dep_tag"].alias("tag"),
            t["depends_on"].cast("int").alias("head"), (F.size(F.get(paths, p - 1)) - 1).alias("depth"),
        )

    return F.transform(path, lambda p: let(F.get(tokens, p - 1), lambda t: node(p, t)))


def has_verb(path: Column) -> Column:
    return F.exists(path, lambda n: n["pos_tag"].rlike(whole(VERB)))


def _first(path: Column, test) -> Column:
    """Place of the first node that passes, from 1; 0 if none does."""
    return F.coalesce(F.array_position(F.transform(path, lambda n: F.coalesce(test(n), F.lit(False))), True), F.lit(0)).cast("int")


def _with(path: Column, place: Column, tag: Column, head: Column | None = None) -> Column:
    def change(n: Column, i: Column) -> Column:
        changed = n.withField("tag", tag)
        return F.when(i + 1 == place, changed if head is None else changed.withField("head", head)).otherwise(n)

    return F.transform(path, change)


def passive_to_active(path: Column) -> Column:
    """The first passive subject becomes the object."""
    return let(_first(path, lambda n: n["tag"] == "nsubjpass"), lambda place: _with(path, place, F.lit("dobj")))


def resolve_agent(path: Column) -> Column:
    """The first agent (*by*): its object becomes the subject of its verb, the verb's subject its object, and it leaves.

    It stays if no node hangs on it; without its verb on the path only the node itself is left out.
    """
    def turn(agent: Column) -> Column:
        by, verb_at = agent["position"], agent["head"]
        facts = F.struct(
            (_first(path, lambda n: n["position"] == verb_at) > 0).alias("verb"),
            _first(path, lambda n: n["head"] == by).alias("object"),
            _first(path, lambda n: (n["head"] == verb_at) & (n["tag"] == "nsubj")).alias("subject"),
        )

        def change(n: Column, i: Column, known: Column) -> Column:
            inverted = F.when((i + 1 == known["subject"]) & known["verb"], n.withField("tag", F.lit("dobj"))).otherwise(n)
            raised = n.withField("tag", F.lit("nsubj")).withField("head", verb_at)
            return F.when((i + 1 == known["object"]) & known["verb"], raised).otherwise(inverted)

        def turned(known: Column) -> Column:
            nodes = F.transform(path, lambda n, i: change(n, i, known))
            return F.filter(nodes, lambda n: (n["position"] != by) | (known["object"] == 0))

        return F.when(by.isNull(), path).otherwise(let(facts, turned))

    return let(F.get(F.filter(path, lambda n: n["tag"] == "agent"), F.lit(0)), turn)


def collapse(path: Column, label: str) -> Column:
    """Runs of nodes tagged ``label`` collapsed.

    Going down, such a node takes tag, head and place of the one before. Going up it is left out behind one that has
    the label already. A node without the label behind one that has it gives its tag and head to that and leaves.
    """
    def step(done: Column, n: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        rest = F.slice(done, F.lit(1), F.size(done) - 1)
        inherited = n.withField("tag", last["tag"]).withField("head", last["head"])
        given = last.withField("tag", n["tag"]).withField("head", n["head"])
        labelled = F.when(n["depth"] > last["depth"], F.array_append(rest, inherited)).when(last["tag"] == label, done).otherwise(F.array_append(done, n))
        plain = F.when(last["tag"] == label, F.array_append(rest, given)).otherwise(F.array_append(done, n))
        return F.when(F.size(done) == 0, F.array(n)).when(n["tag"] == label, labelled).otherwise(plain)

    return F.aggregate(path, F.expr(f"cast(array() as array<{NODE}>)"), step)


def clean_path(path: Column) -> Column:
    """A path rewritten, or null: it needs a verb before and behind, both ends unchanged and ``LONGEST`` nodes at most."""
    def rewrite(nodes: Column) -> Column:
        def finish(active: Column) -> Column:
            return let(collapse(collapse(active, "conj"), "appos"), lambda done: finish_path(active, done, nodes))

        return F.when(has_verb(nodes), let(let(passive_to_active(nodes), resolve_agent), finish))

    return let(path, rewrite)


def finish_path(active: Column, collapsed: Column, path: Column) -> Column:
    def check(kept: Column) -> Column:
        ends = (F.get(kept, F.lit(0))["position"] == F.get(active, F.lit(0))["position"]) & (
            F.try_element_at(kept, F.lit(-1))["position"] == F.try_element_at(active, F.lit(-1))["position"]
        )
        return F.when((F.size(path) > 0) & has_verb(path) & (F.size(kept) > 0) & ends & has_verb(kept) & (F.size(kept) <= LONGEST), kept)

    return let(F.filter(collapsed, lambda n: ~n["tag"].isin("punct", "hyph")), check)


def print_path(path: Column, tokens: Column) -> Column:
    """The label: the first tag, for each node between an arrow and what it says, an arrow and the last tag.

    ``<-`` leads to a deeper node, ``->`` to any other. A verb says its lemma, ``:VB`` and its negation or complement off the path, a
    noun its lemma, tag and its modifiers off the path whose lemma is no semantic type; both only of adjectives, verbs and nouns.
    """
    content = whole("|".join((ADJECTIVE, VERB, NOUN)))

    def beside(n: Column, tags: str, types: bool) -> Column:
        def fits(t: Column) -> Column:
            off = ~F.exists(path, lambda x: x["position"] == t["position"])
            fit = (t["depends_on"] == n["position"]) & t["dep_tag"].rlike(whole(tags)) & off & t["pos_tag"].rlike(content)
            return fit & ~t["lemma"].isin(LABEL_SEMTYPES) if types else fit

        ordered = F.array_sort(F.transform(F.filter(tokens, fits), lambda t: F.struct(t["position"].alias("p"), t["lemma"].alias("l"))))
        words = lambda found: F.array_join(F.transform(found, lambda t: t["l"]), " ")
        return let(ordered, lambda found: F.when(F.size(found) > 0, F.concat(F.lit("("), words(found), F.lit(")"))).otherwise(""))

    def say(n: Column) -> Column:
        verb = F.when(n["pos_tag"].rlike(whole(VERB)), F.concat(F.lit(":VB"), beside(n, "neg|acomp", False))).otherwise("")
        noun = F.when(n["pos_tag"].rlike(whole(NOUN)), F.concat(F.lit(":"), n["tag"], beside(n, "amod|nn|neg", True))).otherwise("")
        return F.concat(n["lemma"], verb, noun)

    def part(n: Column, i: Column) -> Column:
        arrow = F.when(F.get(path, i - 1)["depth"] < n["depth"], " <- ").otherwise(" -> ")
        last = i == F.size(path) - 1
        return F.when(i == 0, n["tag"]).when(last, F.concat(arrow, n["tag"])).otherwise(F.concat(arrow, say(n)))

    arrow = F.when(F.size(path) == 1, F.concat(F.lit(" -> "), F.get(path, F.lit(0))["tag"])).otherwise("")
    return F.concat(F.array_join(F.transform(path, part), ""), arrow)
