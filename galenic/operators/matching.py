"""Detections between images: clean-up, pair scores, optimal assignment, sibling reads and positional matching.

Pairs are made within an image or a run only, by equality joins on those; what has to be solved in order runs
in a grouped function over one image, which holds tens of boxes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G

#: Weights of the pair score and its thresholds.
W_VISUAL, W_LOT, W_NDC, W_BARCODE, W_EXP, W_PREFIX = 0.35, 0.30, 0.15, 0.30, 0.05, 0.075
THRESHOLD = 0.45
VISUAL_FLOOR = 0.55
#: Which class wins a merge, the highest first.
CLASS_PRIORITY = {"bottle": 5, "vial": 4, "iv bag": 3, "bag": 2, "filter": 1}


def _equal(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def pair_scores(detections: DataFrame, priority: tuple[str, ...] = ()) -> DataFrame:
    """run, image, sub_id, ref_id, visual, score: each box of later images with each of the reference image's, by run.
    Shared lots with fair visual likeness, and shared codes that are expected, lift a pair over the threshold."""
    cols = ["run", "image", "pos", "instance_id", "lot", "ndc", "exp", "v"]
    d = detections.select(*cols)
    subs = d.where(F.col("image") != 0).select("run", *[F.col(c).alias(f"s_{c}") for c in cols[1:]])
    refs = d.where(F.col("image") == 0).select("run", *[F.col(c).alias(f"r_{c}") for c in cols[2:]])
    visual = G.cosine(F.col("s_v"), F.col("r_v"))
    pairs = subs.join(refs, "run").withColumn("visual", visual)
    same = {c: _equal(F.col(f"s_{c}"), F.col(f"r_{c}")) for c in ("lot", "ndc", "exp")}
    prefix = _equal(F.split("s_ndc", "-")[0], F.split("r_ndc", "-")[0])
    ndc = F.when(same["ndc"], W_NDC).when(prefix, W_PREFIX).otherwise(0.0)
    score = W_VISUAL * F.col("visual") + F.when(same["lot"], W_LOT).otherwise(0.0) + ndc + F.when(same["exp"], W_EXP).otherwise(0.0)
    near = F.col("visual") >= VISUAL_FLOOR
    score = F.when(same["lot"] & near, F.greatest(score, THRESHOLD + 0.10 + 0.1 * F.col("visual"))).otherwise(score)
    if priority:
        score = F.when(same["ndc"] & F.col("s_ndc").isin(*priority) & near, F.greatest(score, F.lit(THRESHOLD + 0.25))).otherwise(score)
    return pairs.select("run", F.col("s_image").alias("image"), F.col("s_instance_id").alias("sub_id"), F.col("r_instance_id").alias("ref_id"), F.col("r_pos").alias("slot"), "visual", score.alias("score"))


def best_assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns of the largest total, each used once: shortest augmenting paths with potentials."""
    flip = score.shape[0] > score.shape[1]
    cost = -(score.T if flip else score)
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m + 1)
    row_of = np.full(m + 1, -1)
    for i in range(n):
        row_of[m] = i
        column, least, back = m, np.full(m, np.inf), np.full(m, m)
        done = np.zeros(m + 1, bool)
        while row_of[column] >= 0:
            done[column] = True
            reach = cost[row_of[column]] - u[row_of[column]] - v[:m]
            better = ~done[:m] & (reach < least)
            least[better], back[better] = reach[better], column
            free = np.where(done[:m], np.inf, least)
            following = int(free.argmin())
            step = free[following]
            used = np.flatnonzero(done)
            u[row_of[used]] += step
            v[used] -= step
            least[~done[:m]] -= step
            column = following
        while column != m:
            row_of[column] = row_of[back[column]]
            column = int(back[column])
    pairs = [(int(r), c) for c, r in enumerate(row_of[:m]) if r >= 0]
    return sorted((c, r) if flip else (r, c) for r, c in pairs)


def assigned(scores: DataFrame, threshold: float = THRESHOLD, force: bool = False) -> DataFrame:
    """run, image, sub_id, slot, score, status of each box of later images: assigned to a slot of the reference image, forced
    there below the threshold, out of inventory, or in excess of the slots. One grouped task solves one image."""

    def solve(pairs: pd.DataFrame) -> pd.DataFrame:
        subs, slots = np.unique(pairs["sub_id"]), np.unique(pairs["slot"])
        matrix = np.zeros((len(subs), len(slots)))
        matrix[np.searchsorted(subs, pairs["sub_id"]), np.searchsorted(slots, pairs["slot"])] = pairs["score"]
        chosen = {r: c for r, c in best_assignment(matrix) if force or matrix[r, c] >= threshold}
        out = []
        for r, sub in enumerate(subs):
            if r in chosen:
                s = matrix[r, chosen[r]]
                out.append((int(sub), int(slots[chosen[r]]), float(s), "forced" if s < threshold else "assigned"))
            else:
                out.append((int(sub), None, float(matrix[r].max()), "excess" if force else "out_of_inventory"))
        rows = pd.DataFrame(out, columns=["sub_id", "slot", "score", "status"])
        return rows.assign(run=pairs["run"].iat[0], image=pairs["image"].iat[0])[["run", "image", "sub_id", "slot", "score", "status"]]

    return scores.groupBy("run", "image").applyInPandas(solve, "run long, image long, sub_id long, slot long, score double, status string")


def without_frames(detections: DataFrame, width: int, height: int, limit: float = 0.80) -> DataFrame:
    """Drops boxes that span the frame."""
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    return detections.where(G.coverage(*box, F.lit(width), F.lit(height)) < limit)


def reflections(detections: DataFrame) -> DataFrame:
    """run, image, instance_id, parent: boxes that sit below a box of twice their mask or more and overlap it by 30 % of
    their width; the first such box by position is the parent."""
    cols = ["pos", "instance_id", "x1", "y1", "x2", "y2", "mask_area"]
    o = detections.select("run", "image", *[F.col(c).alias(f"o_{c}") for c in cols])
    d = detections.select("run", "image", *cols)
    gap = F.col("y1") - F.col("o_y2")
    overlap = F.least("x2", "o_x2") - F.greatest("x1", "o_x1")
    below = (gap >= -0.05 * (F.col("y2") - F.col("y1"))) & (gap <= 30) & (overlap >= 0.30 * (F.col("x2") - F.col("x1"))) & (F.col("o_mask_area") >= 2 * F.col("mask_area"))
    pairs = d.join(o, ["run", "image"]).where((F.col("instance_id") != F.col("o_instance_id")) & below)
    return pairs.groupBy("run", "image", "instance_id").agg(F.min_by("o_instance_id", "o_pos").alias("parent"))


def merged(detections: DataFrame, iou_limit: float = 0.7) -> DataFrame:
    """Greedy suppression over the classes of an image: by class priority, then score, a box joins the first kept box that it
    overlaps, which takes over fields it lacks. run, image, instance_id, lot, ndc, exp, absorbed (ids joined by commas)."""

    def suppress(boxes: pd.DataFrame) -> pd.DataFrame:
        boxes = boxes.assign(p=boxes["class_label"].map(CLASS_PRIORITY).fillna(0)).sort_values(["p", "score", "pos"], ascending=[False, False, True])
        kept: list[dict] = []
        for b in boxes.to_dict("records"):
            for k in kept:
                w, h = min(b["x2"], k["x2"]) - max(b["x1"], k["x1"]), min(b["y2"], k["y2"]) - max(b["y1"], k["y1"])
                both = max(0, w) * max(0, h)
                if both and both / ((b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) + (k["x2"] - k["x1"]) * (k["y2"] - k["y1"]) - both) >= iou_limit:
                    k |= {c: b[c] for c in ("lot", "ndc", "exp") if pd.isna(k[c]) or not k[c]}
                    k["absorbed"].append(b["instance_id"])
                    break
            else:
                kept.append(b | {"absorbed": []})
        out = pd.DataFrame(kept)
        out["absorbed"] = [",".join(map(str, x)) for x in out["absorbed"]]
        return out[["run", "image", "instance_id", "lot", "ndc", "exp", "absorbed"]]

    rows = detections.drop("v")
    return rows.groupBy("run", "image").applyInPandas(suppress, "run long, image long, instance_id long, lot string, ndc string, exp string, absorbed string")


def sibling_pairs(detections: DataFrame, area_ratio: float = 0.85, aspect_difference: float = 0.15) -> DataFrame:
    """run, image, a, b: boxes of one image whose mask areas and aspects are alike, each pair once."""
    d = detections.select("run", "image", "instance_id", "mask_area", G.aspect(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("aspect"))
    o = d.select("run", "image", F.col("instance_id").alias("b"), F.col("mask_area").alias("b_area"), F.col("aspect").alias("b_aspect"))
    alike = (F.least("mask_area", "b_area") / F.greatest("mask_area", "b_area") >= area_ratio) & (F.abs(F.col("aspect") - F.col("b_aspect")) <= aspect_difference)
    return d.join(o, ["run", "image"]).where((F.col("instance_id") < F.col("b")) & (F.col("mask_area") > 0) & (F.col("b_area") > 0) & alike).select("run", "image", F.col("instance_id").alias("a"), "b")


def siblings_filled(detections: DataFrame) -> DataFrame:
    """run, image, instance_id, lot, ndc, exp, filled: of boxes that likeness connects within an image the richest read (code 4,
    lot 2, expiry 1; the first of equals) fills what the others lack."""
    pairs = sibling_pairs(detections)

    def reach(p: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b in zip(p["a"], p["b"], strict=True):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
        ids = list(parent)
        return pd.DataFrame({"run": p["run"].iat[0], "image": p["image"].iat[0], "instance_id": ids, "grp": [root(x) for x in ids]})

    groups = pairs.groupBy("run", "image").applyInPandas(reach, "run long, image long, instance_id long, grp long")
    d = detections.select("run", "image", "pos", "instance_id", "lot", "ndc", "exp").join(groups.select("instance_id", "grp"), "instance_id", "left")
    d = d.withColumn("grp", F.coalesce("grp", "instance_id"))
    richness = F.col("ndc").isNotNull().cast("int") * 4 + F.col("lot").isNotNull().cast("int") * 2 + F.col("exp").isNotNull().cast("int")
    best = F.first(F.struct("lot", "ndc", "exp")).over(Window.partitionBy("run", "image", "grp").orderBy(richness.desc(), "pos"))
    d = d.withColumn("best", best)
    filled = F.concat_ws(",", *[F.when(F.col(c).isNull() & F.col(f"best.{c}").isNotNull(), c) for c in ("lot", "ndc", "exp")])
    return d.select("run", "image", "instance_id", *[F.coalesce(F.col(c), F.col(f"best.{c}")).alias(c) for c in ("lot", "ndc", "exp")], filled.alias("filled"))


def fifo(left: DataFrame, right: DataFrame, key: str, order: str, group: str) -> DataFrame:
    """Pairs rows of equal key within a group in turn, the n-th with the n-th: a positional equality join."""
    w = Window.partitionBy(group, key).orderBy(order)
    a = left.where(F.col(key).isNotNull()).withColumn("n", F.row_number().over(w))
    b = right.where(F.col(key).isNotNull()).withColumn("n", F.row_number().over(w))
    return a.select(group, key, "n", F.col(order).alias("a")).join(b.select(group, key, "n", F.col(order).alias("b")), [group, key, "n"])


def image_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (run, image, ...) twice, each with pair (run, image_a, image_b): as the first and as the second image of every two of
    a run, in ascending order. Rows of a run meet only those of its other images."""
    images = rows.select("run", "image").distinct()
    other = images.select("run", F.col("image").alias("other"))
    pairs = images.join(other, "run").where(F.col("image") < F.col("other")).select(F.struct("run", F.col("image").alias("image_a"), F.col("other").alias("image_b")).alias("pair"))
    at = lambda c: rows.join(pairs.select(F.col("pair.run").alias("run"), F.col(f"pair.{c}").alias("image"), "pair"), ["run", "image"])
    return at("image_a"), at("image_b")


#: Tiers of a link in order of precedence.
TIERS = ("identity", "sku", "therapeutic")


def classified_pairs(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """group, i, j, tier, score of pairs of components (id, type, ndc, lot, exp, mfg, product, strength) of two images of a group."""
    fields = ("id", "type", "ndc", "lot", "exp", "mfg", "product", "strength")
    x = a.select(group, *[F.col(c).alias(f"a_{c}") for c in fields])
    y = b.select(group, *[F.col(c).alias(f"b_{c}") for c in fields])
    p = x.join(y, group).where(F.col("a_type") == F.col("b_type"))
    both = lambda c: F.col(f"a_{c}").isNotNull() & F.col(f"b_{c}").isNotNull()
    same = {c: F.coalesce(F.lower(f"a_{c}") == F.lower(f"b_{c}"), F.lit(False)) for c in fields[2:]}
    differ = {c: both(c) & ~same[c] for c in fields[2:]}
    clean = ~(differ["ndc"] | differ["lot"] | differ["exp"] | differ["mfg"])
    one = lambda c, v: F.when(same[c], v).otherwise(0.0)
    tier = lambda name, score: F.struct(F.lit(name).alias("tier"), score.alias("score"))
    link = (
        F.when(clean & same["ndc"] & same["lot"], tier("identity", 10.0 + one("exp", 1.0) + one("mfg", 0.5)))
        .when(clean & same["lot"] & (same["exp"] | same["mfg"]), tier("identity", 8.0 + one("mfg", 0.5)))
        .when(same["ndc"] & ~(differ["mfg"] | differ["product"]), tier("sku", 6.0 + one("strength", 0.5)))
        .when(same["product"] & same["strength"] & same["mfg"] & ~(differ["ndc"] | differ["lot"]), tier("sku", F.lit(5.0)))
        .when(same["product"] & same["strength"] & (differ["mfg"] | differ["ndc"]), tier("therapeutic", F.lit(3.5)))
        .when(same["product"] & same["strength"] & ~(differ["mfg"] | differ["ndc"]), tier("therapeutic", F.lit(2.5)))
    )
    p = p.select(group, F.col("a_id").alias("i"), F.col("b_id").alias("j"), link.alias("link")).where(F.col("link").isNotNull())
    return p.select(group, "i", "j", "link.tier", "link.score")


def tiered_links(pairs: DataFrame, group: str, margin: float = 1.0) -> DataFrame:
    """group, i, j, tier, score, ambiguous: tier by tier the pairs within the margin of both sides' best. A class whose only
    partner of a tier that is takes part in no lower tier; ambiguous ones stay."""
    used_i = used_j = out = None
    for tier in TIERS:
        p = pairs.where(F.col("tier") == tier)
        if used_i is not None:
            p = p.join(used_i, [group, "i"], "left_anti").join(used_j, [group, "j"], "left_anti")
        best_i, best_j = F.max("score").over(Window.partitionBy(group, "i")), F.max("score").over(Window.partitionBy(group, "j"))
        p = p.withColumn("bi", best_i).withColumn("bj", best_j).where((F.col("score") >= F.col("bi") - margin) & (F.col("score") >= F.col("bj") - margin))
        p = p.withColumn("ni", F.count(F.lit(1)).over(Window.partitionBy(group, "i"))).withColumn("nj", F.count(F.lit(1)).over(Window.partitionBy(group, "j")))
        links = p.select(group, "i", "j", "tier", "score", ((F.col("ni") > 1) | (F.col("nj") > 1)).alias("ambiguous"))
        out = links if out is None else out.unionByName(links)
        now_i, now_j = p.where(F.col("ni") == 1).select(group, "i").distinct(), p.where(F.col("nj") == 1).select(group, "j").distinct()
        used_i, used_j = (now_i, now_j) if used_i is None else (used_i.unionByName(now_i), used_j.unionByName(now_j))
    return out


def order_sides(expected: DataFrame, found: DataFrame, *more: str) -> DataFrame:
    """order_id, pos, and of each row either e, an expected component, or f, a found one; both sides of an order stand together."""
    e = F.struct("product_ndc", "package_ndc", "lot", "exp", *more).alias("e")
    both = expected.select("order_id", "pos", e).unionByName(found.select("order_id", "pos", F.struct("ndc", "lot", "exp").alias("f")), allowMissingColumns=True)
    return both.repartition("order_id")


def verified(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Of each expected component (order_id, pos, product_ndc, package_ndc, lot, exp) the first found one of its code:
    found, lot_match, exp_match (null where one side has none) and discrepant."""
    return verified_sides(order_sides(expected, found)).drop("e")


def verified_sides(sides: DataFrame) -> DataFrame:
    """verified(), with e, for rows that may have an expected component (e), a found one (f), or both at one place. Partitioned by
    order_id, the rows aren't moved again: what is found is looked up by code and chosen by place in windows within the order."""
    e, f = F.col("e"), F.col("f")
    kinds = sides.select("pos", "f.lot", "f.exp").schema
    h0 = "struct<" + ",".join(f"{c.name}:{c.dataType.simpleString()}" for c in kinds) + ">"
    asks = lambda code, own: F.struct(code.alias("ndc"), F.lit(True).alias("asks"), own.alias("own"), F.lit(None).cast(h0).alias("h"))
    has = F.struct(f["ndc"].alias("ndc"), F.lit(False).alias("asks"), F.lit(False).alias("own"), F.struct(F.col("pos"), f["lot"].alias("lot"), f["exp"].alias("exp")).alias("h"))
    each = F.array_compact(F.array(F.when(e.isNotNull(), asks(e["package_ndc"], F.lit(True))), F.when(e.isNotNull(), asks(e["product_ndc"], F.lit(False))), F.when(f.isNotNull(), has)))
    k = sides.select("order_id", "pos", "e", F.explode(each).alias("k")).select("order_id", "pos", F.when(F.col("k.own"), e).alias("e"), "k.ndc", "k.asks", "k.own", "k.h")
    known = F.col("order_id").isNotNull() & F.col("ndc").isNotNull()  # nulls equal nothing
    first = F.when(F.col("asks") & known & F.col("pos").isNotNull(), F.min("h").over(Window.partitionBy("order_id", "ndc")))
    k = k.withColumn("first", first).withColumn("h", F.min("first").over(Window.partitionBy("order_id", "pos"))).where("own")
    there = F.col("h").isNotNull()
    lot, exp = F.col("e.lot") == F.col("h.lot"), F.col("e.exp") == F.col("h.exp")
    discrepant = ~there | lot.eqNullSafe(F.lit(False)) | exp.eqNullSafe(F.lit(False))
    return k.select("order_id", "pos", there.alias("found"), lot.alias("lot_match"), exp.alias("exp_match"), discrepant.alias("discrepant"), "e")
