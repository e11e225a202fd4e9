"""Programs as text, and the registry."""

import random

import pytest

from graphloom import operators as O
from graphloom.model import from_tables
from graphloom.plans.programs import explain_program, from_xml, load, register_callable, save, simplified, to_xml


def always(ag):
    return None


PROGRAMS = [
    O.degree((1, 4)), O.graphlet(2, (2, 4)), O.compose(O.merge(), O.path(2), O.cycle()), O.intersection(node_size=(1, 3)), O.compose_product(O.binary_intersection(), O.cycle(), O.neighborhood(1)),
    O.if_then_elif_else((always, O.node()), O.edge()), O.for_loop(O.neighborhood(1), n_iterations=2), O.filter_by_node_label(must_have_one_of=["a'\"<"]).annotate(why="test"),
]


@pytest.mark.parametrize("op", PROGRAMS)
def test_round_trip(op, tmp_path):
    register_callable("always", always)
    assert from_xml(to_xml(op)) == op
    assert load(save(op, str(tmp_path / "p.xml"))) == op


def test_unknown_names_are_errors():
    for text in ("<Operator type='nothing'/>", "<Operator type='node' x='1'/>", "<Other/>"):
        with pytest.raises(ValueError):
            from_xml(text)


def test_simplified():
    op = O.forward_compose(O.identity(), O.node(), O.deduplicate(), O.deduplicate(), O.filter_by_number_of_nodes((1, 5)), O.filter_by_number_of_nodes((2, 9)))
    assert simplified(op) == O.forward_compose(O.deduplicate(), O.node(), O.filter_by_number_of_nodes((2, 5)))
    assert simplified(O.compose(O.identity(), O.node(), O.identity())) == O.compose(O.node(), O.deduplicate())
    plain = O.forward_compose(O.identity(), O.node(), O.deduplicate(), O.deduplicate(), dedup=False)
    assert simplified(plain) == O.forward_compose(O.node(), O.deduplicate(), dedup=False)
    assert simplified(O.compose(O.identity(), O.identity(), dedup=False)) == O.compose(O.identity(), dedup=False)


def test_size_filters_become_bounds(spark):
    """A filter after an operator that can bound the size itself goes into its parameters; where nothing would be left it stays."""
    small = O.filter_by_number_of_nodes((2, 3))
    assert simplified(O.forward_compose(O.clique((1, 4)), small)) == O.forward_compose(O.clique((2, 3)))
    assert simplified(O.compose(small, O.graphlet(2, (1, 5)))) == O.compose(O.graphlet(2, (2, 3)))
    assert simplified(O.forward_compose(O.path((1, 4)), small, O.node())) == O.forward_compose(O.path((1, 2)), O.node())
    none = O.forward_compose(O.clique((4, 5)), small)
    assert simplified(none) == none
    n = spark.createDataFrame([(1, i, "x") for i in range(6)], "graph_id long, node_id long, label string")
    e = spark.createDataFrame([(1, i, j, "-") for i in range(6) for j in range(i) if (i + j) % 3], "graph_id long, src long, dst long, label string")
    ag = from_tables(n, e, False)
    for made, filtered in ((O.clique((1, 4)), small), (O.graphlet(1, (1, 4)), O.filter_by_number_of_nodes(3)), (O.path((1, 3)), O.filter_by_number_of_nodes((1, 2)))):
        op = O.forward_compose(made, filtered)
        found = [sorted(tuple(r.nodes) for r in x(ag).sg.select("nodes").collect()) for x in (op, simplified(op))]
        assert found[0] == found[1] and simplified(op) != op


def test_simplified_on_repeated_subgraphs(spark):
    """Random programs of stages, on subgraphs that stand twice: the same result with and without simplification."""
    n = spark.createDataFrame([(1, i, "x") for i in range(5)], "graph_id long, node_id long, label string")
    e = spark.createDataFrame([(1, i, (i + 1) % 5, "-") for i in range(5)], "graph_id long, src long, dst long, label string")
    ag = from_tables(n, e, False)
    ag = O.add(O.edge(), O.edge(), O.node())(ag)
    stages = [O.identity(), O.identity(), O.deduplicate(), O.filter_by_number_of_nodes((1, 2)), O.filter_by_number_of_nodes((2, 9)), O.filter_by_sampling(2, 1), O.node()]
    rng = random.Random(6)
    for _ in range(8):
        make = rng.choice([O.compose, O.forward_compose])
        op = make(*rng.choices(stages, k=rng.randint(1, 5)), dedup=rng.random() < 0.6)
        found = [sorted(tuple(r.nodes) for r in x(ag).sg.select("nodes").collect()) for x in (op, simplified(op))]
        assert found[0] == found[1], op


def test_catalog(spark):
    assert explain_program(spark, PROGRAMS[2]).count() == 4
    assert {r.name for r in O.catalog(spark).select("name").collect()} >= {"node", "low_cut_partition", "while_loop"}
