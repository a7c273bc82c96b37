from pagemill.plans import registry
from pagemill.plans import views as V


def iou(a, b):
    w, h = (min(a[k] + a[s], b[k] + b[s]) - max(a[k], b[k]) for k, s in ("xw", "yh"))
    return w * h / (a.w * a.h + b.w * b.h - w * h) if w > 0 and h > 0 else 0.0


def test_f1(spark, tmp_path):
    """Precision, recall and F1 at IoU 0.5 by brute force: nearest pairs first."""
    docs = [(p, "\n".join("x" * (1 + (p * k) % 60) for k in range(n))) for p, n in ((1, 5), (4, 52), (6, 23))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    left, right = V.regions(spark, str(tmp_path)).collect(), V.jitter(spark, str(tmp_path)).collect()
    pairs = sorted((1 - iou(a, b), a.seq, b.seq, a.page) for a in left for b in right if a.page == b.page and iou(a, b) >= 0.5)
    used, tp = set(), 0
    for _, x, y, p in pairs:
        if not {(p, "l", x), (p, "r", y)} & used:
            used |= {(p, "l", x), (p, "r", y)}
            tp += 1
    assert 0 < tp <= len(right) < len(left)
    (got,) = registry.queries()["detection_f1"](spark, str(tmp_path)).collect()
    want = (tp, round(tp / len(right), 6), round(tp / len(left), 6), round(2 * tp / (len(left) + len(right)), 6))
    assert (got.tp, got.precision, got.recall, got.f1) == want


def test_f1_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in registry.queries()["detection_f1"](spark, str(tmp_path)).collect()] == [(0, 0.0, 0.0, 0.0)]
