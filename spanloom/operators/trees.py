"""Dependency trees as token arrays: one array per sentence, in order, positions from 1, heads as positions (0 for the root).

All operators are expressions over the array, so a sentence is handled where it lies.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.constants import whole
from spanloom.functions.let import let


def heads_of(tokens: Column) -> Column:
    """Heads by position; tokens must be numbered without gaps."""
    return F.transform(F.array_sort(F.transform(tokens, lambda t: F.struct(t["position"].alias("p"), t["depends_on"].alias("h")))), lambda t: t["h"])


def root_paths(tokens: Column) -> Column:
    """The root path of every position, in order."""
    return let(heads_of(tokens), root_paths_of)


def root_paths_of(heads: Column) -> Column:
    """Positions from each token up to its root: arrays beginning with the token itself. A head that does not exist ends
    a path like a root; a cycle ends it where it closes.

    Each round appends to a path the one of its topmost token's head, so the known part doubles. There are as many rounds as
    the sentence's size has bits: a path that has not ended by then is longer than the sentence and goes round in a cycle.
    """
    def known(head: Column) -> Column:
        return F.when((head > 0) & (head <= F.size(heads)), head.cast("int")).otherwise(0)

    state = F.transform(heads, lambda h, i: F.struct(F.array((i + 1).cast("int")).alias("path"), known(h).alias("next")))

    def double(paths: Column) -> Column:
        longer = lambda s, up: F.struct(F.concat(s["path"], up["path"]).alias("path"), up["next"].alias("next"))
        return F.transform(paths, lambda s: F.when(s["next"] > 0, let(F.get(paths, s["next"] - 1), lambda up: longer(s, up))).otherwise(s))

    rounds = F.sequence(F.lit(1), F.length(F.bin(F.size(heads))))
    state = F.aggregate(rounds, state, lambda paths, _: double(paths))
    return F.transform(state, lambda s: F.when(s["next"] > 0, F.array_distinct(s["path"])).otherwise(s["path"]))


def depth(path: Column) -> Column:
    """Depth of a token by its root path: 0 for a root or a token whose head does not exist."""
    return F.size(path) - 1


def has_cycle(heads: Column, paths: Column) -> Column:
    """Whether some path ends at a token that still has a head in the sentence."""
    def open_end(path: Column) -> Column:
        head = F.try_element_at(heads, F.try_element_at(path, F.lit(-1)))
        return F.coalesce((head > 0) & (head <= F.size(heads)), F.lit(False))

    return F.exists(paths, open_end)


def subtree(paths: Column, position: Column) -> Column:
    """Positions below and including a token, ascending."""
    below = F.transform(paths, lambda path, i: F.when(F.array_contains(path, position.cast("int")), i + 1))
    return F.filter(below, lambda p: p.isNotNull())


def pretty_print(tokens: Column, paths: Column) -> Column:
    """One line per token: two tabs for each level of depth, then head, tag, lemma and position."""
    ordered = F.array_sort(F.transform(tokens, lambda t: F.struct(t["position"].alias("p"), t["depends_on"].alias("h"), t["dep_tag"].alias("g"), t["lemma"].alias("l"))))
    line = lambda t: F.concat(
        F.repeat(F.lit("\t"), 2 * depth(F.get(paths, t["p"] - 1))), F.concat_ws(":", t["h"].cast("string"), t["g"], t["l"], t["p"].cast("string"))
    )
    return F.array_join(F.transform(ordered, line), "\n")


def dependency_path(paths: Column, start: Column, end: Column, from_tokens: Column, to_tokens: Column) -> Column:
    """The path between two mentions over their lowest common token, as positions; null if they have none.

    ``start`` and ``end`` are the mentions' shallowest tokens, ``from_tokens`` and ``to_tokens`` all their positions. Upwards it
    stops at the first token of the target mention; downwards leading tokens of the source mention are left out.
    """
    none = F.expr("cast(array() as array<int>)")

    def cut(up: Column) -> Column:
        return let(F.array_position(up, end.cast("int")).cast("int"), lambda met: F.when(met > 0, F.slice(up, F.lit(1), met)).otherwise(up))

    def join(up_all: Column, down_all: Column, common: Column) -> Column:
        stops = F.transform(up_all, lambda t: (t == common) | F.array_contains(to_tokens, t))
        up = F.slice(up_all, F.lit(1), F.array_position(stops, True).cast("int") - 1)
        below = F.reverse(F.slice(down_all, F.lit(1), F.array_position(down_all, common).cast("int") - 1))

        def fresh(down: Column) -> Column:
            first = F.array_position(F.transform(down, lambda t: ~F.array_contains(from_tokens, t)), True).cast("int")
            return let(first, lambda at: F.when(at > 0, F.slice(down, at, F.size(down))).otherwise(none))

        return F.when(common.isNotNull(), F.concat(up, F.array(common), let(below, fresh)))

    def meet(up_all: Column) -> Column:
        down_all = F.get(paths, end - 1)
        shared = F.get(F.filter(down_all, lambda t: F.array_contains(up_all, t)), F.lit(0))
        return let(shared, lambda common: join(up_all, down_all, common))

    return let(let(F.get(paths, start - 1), cut), meet)


def shallowest(positions: Column, paths: Column) -> Column:
    """The position of least depth, the smallest on ties."""
    return F.array_min(F.transform(positions, lambda p: F.struct(depth(F.get(paths, p - 1)).alias("d"), p.alias("p"))))["p"]


def find(tokens: Column, test: Callable[[Column], Column]) -> Column:
    """The first token, in order of position, that passes; null if none does."""
    return F.get(F.filter(F.array_sort(tokens, lambda a, b: a["position"] - b["position"]), lambda t: F.coalesce(test(t), F.lit(False))), F.lit(0))


def node_of(tokens: Column, position: Column | int) -> Column:
    """The token at a position; null if there is none."""
    return find(tokens, lambda t: t["position"] == position)


@dataclass(frozen=True)
class Template:
    """A tree to match: the pattern for its topmost node, and for each branch the pattern for the edge and what hangs on it."""

    node: str = ".*"
    branches: tuple[tuple[str, Template], ...] = ()


def match_tree(edges: DataFrame, key: list[str], template: Template, label: str = "lemma") -> DataFrame:
    """All matches of a tree template, as ``p_0 .. p_n`` in the order of its nodes from the top, branch by branch.

    ``edges`` as for :func:`match_template`. Every combination of what the branches match is a match of its own; two branches
    may match the same node. One join by sentence and head for each edge of the template.
    """
    found = edges.where(F.col(label).rlike(whole(template.node))).select(*key, F.col("position").alias("p_0"))
    used = 0

    def grow(found: DataFrame, top: int, branches: tuple[tuple[str, Template], ...]) -> DataFrame:
        nonlocal used
        for tag, below in branches:
            used += 1
            own = used
            step = edges.where(F.col("dep_tag").rlike(whole(tag)) & F.col(label).rlike(whole(below.node)))
            found = found.join(step.select(*key, F.col("head").alias(f"p_{top}"), F.col("position").alias(f"p_{own}")), [*key, f"p_{top}"])
            found = grow(found, own, below.branches)
        return found

    found = grow(found, 0, template.branches)
    return found.select(*key, *[f"p_{i}" for i in range(used + 1)])


def match_template(edges: DataFrame, key: list[str], steps: list[tuple[str, str]], root: str = ".*", label: str = "lemma") -> DataFrame:
    """All matches of a linear template, as ``p_0 .. p_n``.

    ``edges`` has ``key``, ``position``, ``head``, ``dep_tag`` and the node's ``label``; ``steps`` are pairs of patterns for the edge's tag
    and the lower node's label, each to match whole, ``root`` the pattern for the topmost node. One join by sentence and head
    for each step, none of them by broadcast: edges unfolded from token arrays are taken for as small as the arrays' files, so the
    planner would gather whole corpora on the driver. For branching templates see :func:`match_tree`.
    """
    found = edges.where(F.col(label).rlike(whole(root))).select(*key, F.col("position").alias("p_0"))
    for at, (tag, node) in enumerate(steps, 1):
        step = edges.where(F.col("dep_tag").rlike(whole(tag)) & F.col(label).rlike(whole(node)))
        step = step.select(*key, F.col("head").alias(f"p_{at - 1}"), F.col("position").alias(f"p_{at}"))
        found = found.join(step.hint("merge"), [*key, f"p_{at - 1}"])
    return found


def nominal_relations(edges: DataFrame, key: list[str], subject: str = "nsubj|.obj", preposition: str = "prep", object_: str = "pobj", of: str = "of") -> DataFrame:
    """``(key, position, head, label)`` of the roles that nouns give to their prepositional complements.

    For ``x -(subject)-> n -(preposition)-> p -(object)-> o``: with the preposition *of* the object takes the role A1 of ``n``, else the
    preposition takes AM, once for each object. A node without a lemma matches like any other. For token arrays see
    :func:`nominal_roles`, which joins nothing.
    """
    edges = edges.withColumn("lemma", F.coalesce("lemma", F.lit("")))
    anything = "(?s).*"
    found = match_template(edges, key, [(subject, anything), (preposition, anything), (object_, anything)], anything)
    prep = edges.select(*key, F.col("position").alias("p_2"), F.col("lemma").alias("prep_lemma"))
    found = found.join(prep.hint("merge"), [*key, "p_2"])
    genitive = F.col("prep_lemma") == of
    return found.select(
        *key, F.when(genitive, F.col("p_3")).otherwise(F.col("p_2")).alias("position"), F.col("p_1").alias("head"),
        F.when(genitive, "A1").otherwise("AM").alias("label"),
    )


def nominal_roles(tokens: Column, subject: str = "nsubj|.obj", preposition: str = "prep", object_: str = "pobj", of: str = "of") -> Column:
    """The roles of :func:`nominal_relations` as ``(position, head, label)``, from a sentence's tokens, in order and numbered without gaps.

    Matched upwards: every object has one preposition above it and that one noun, found by position, so the work is linear in
    the sentence's size.
    """
    tagged = lambda t, tag: t["dep_tag"].rlike(whole(tag))
    above = lambda t: F.get(tokens, t["depends_on"] - 1)

    def role(o: Column, p: Column, n: Column) -> Column:
        genitive = p["lemma"] == of
        said = F.struct(
            F.when(genitive, o["position"]).otherwise(p["position"]).alias("position"), n["position"].alias("head"), F.when(genitive, "A1").otherwise("AM").alias("label"),
        )
        return F.when(tagged(p, preposition) & tagged(n, subject) & above(n).isNotNull(), said)

    objects = F.filter(tokens, lambda t: tagged(t, object_))
    roles = F.transform(objects, lambda o: let(above(o), lambda p: let(above(p), lambda n: role(o, p, n))))
    return F.filter(roles, lambda r: r.isNotNull())


def print_roles(tokens: Column, paths: Column, roles: Column) -> Column:
    """``label(head lemma,argument)`` of each role ``(position, head, label)``, joined by tabs: the argument is the text below
    the token if it lies deeper than the head, else its lemma."""
    by = lambda p, field: F.get(tokens, p - 1)[field]

    def argument(role: Column) -> Column:
        deeper = depth(F.get(paths, role["position"] - 1)) > depth(F.get(paths, role["head"] - 1))
        below = F.array_join(F.transform(subtree(paths, role["position"]), lambda p: by(p, "covered_text")), " ")
        return F.when(deeper, below).otherwise(by(role["position"], "lemma"))

    return F.array_join(F.transform(roles, lambda r: F.concat(r["label"], F.lit("("), by(r["head"], "lemma"), F.lit(","), argument(r), F.lit(")"))), "\t")


def role_triples(tokens: Column, paths: Column, roles: Column) -> Column:
    """For each role ``(position, head, label)`` a struct of its label, the head's lemma and position, and the text below the
    token with its position."""
    def triple(role: Column) -> Column:
        argument = F.array_join(F.transform(subtree(paths, role["position"]), lambda p: F.get(tokens, p - 1)["covered_text"]), " ")
        return F.struct(
            role["label"].alias("label"), F.get(tokens, role["head"] - 1)["lemma"].alias("predicate"), role["head"].alias("predicate_at"),
            argument.alias("argument"), role["position"].alias("argument_at"),
        )

    return F.transform(roles, triple)


def tree_checks(sentences: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """``(key, n_tokens, roots, missing_heads, cycle)`` per sentence."""
    heads = sentences.select(key, heads_of(F.col(tokens)).alias("heads"))
    heads = heads.withColumn("paths", root_paths_of(F.col("heads")))
    return heads.select(
        key, F.size("heads").alias("n_tokens"), F.size(F.filter("heads", lambda h: h == 0)).alias("roots"),
        F.size(F.filter("heads", lambda h: (h < 0) | (h > F.size("heads")))).alias("missing_heads"), has_cycle(F.col("heads"), F.col("paths")).alias("cycle"),
    )


def zip_nodes(words: Column, nodes: Column) -> Column:
    """Token strings and parse nodes by place, as ``word`` and ``node``; what one of both has more is left out."""
    size = F.least(F.size(words), F.size(nodes))
    return F.transform(F.arrays_zip(F.slice(words, F.lit(1), size).alias("word"), F.slice(nodes, F.lit(1), size).alias("node")), lambda z: F.struct(z["word"].alias("word"), z["node"].alias("node")))


def number_tokens(tokens: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Positions from 1 within each sentence."""
    return tokens.withColumn("position", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
