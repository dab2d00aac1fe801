"""A specification's vector and place, against its two parts."""

from vialattice.operators import generate, spec
from vialattice.plans import generate_queries
from vialattice.plans.fixtures import index

DATA = "/root/testdata/sf0.001"


def test_resolved_in_place(spark):
    rows, lanes = index(spark, DATA).withColumnRenamed("label", "speed"), generate_queries._context_lanes(spark, DATA)
    first = lanes.select("camera", "group_id").orderBy("camera", "group_id").first()
    here = {"camera": first["camera"], "group_id": first["group_id"]}
    for asked, flags in ((spec.LaneSpec.rightmost(**here), {"right": True}), (spec.LaneSpec.leftmost(**here), {"left": True}), (spec.LaneSpec.merge(**here), {"successor": True}), (spec.LaneSpec.replace_role(2, "leftmost", **here), {"left": True, "replace": 2})):
        (got,) = generate.resolve_in_place(rows, lanes, asked).collect()
        assert got["e"] == generate.resolve(rows, asked).first()["e"]
        assert got["context"] == generate.spatial_context(lanes, **flags).where(f"camera = '{first['camera']}' and group_id = {first['group_id']}").first()
    for asked in (spec.LaneSpec.rightmost(), spec.LaneSpec.rightmost(camera="none", group_id=0)):
        (got,) = generate.resolve_in_place(rows, lanes, asked).collect()
        assert got["context"] is None and len(got["e"]) == 64
