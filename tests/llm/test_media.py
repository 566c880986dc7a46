import numpy as np
import pytest

from meshframe.llm import media as M


def texture(seed, h=120, w=140):
    r = np.random.default_rng(seed)
    a = M.resize(r.random((h // 5, w // 5)).astype(np.float32), h, w) + 0.35 * M.resize(r.random((h // 2, w // 2)).astype(np.float32), h, w)
    return np.clip(a / a.max() * 235, 0, 255)


def gallery():
    images = {i: texture(i) for i in range(8)}
    images[20] = images[1][10:110, 15:130]  # cropped
    images[21] = np.clip(images[2] * 0.8 + 20, 0, 255)  # darker
    images[22] = np.rot90(images[3]).copy()  # turned
    images[23] = np.clip(images[4] + np.random.default_rng(0).normal(0, 1.5, images[4].shape), 0, 255)  # noisy
    images[24] = images[1].copy()  # equal
    images[25] = images[20][5:, 5:]  # cropped again
    return images


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, M.encode(a)) for i, a in gallery().items()]
    rows += [(50, None), (51, b""), (52, b"P5\n9 9\n255\nshort"), (53, M.encode(np.full((60, 60), 90))), (54, M.encode(np.full((60, 60), 90))), (None, M.encode(texture(99)))]
    return {r["media_id"]: r for r in M.image_copies(spark.createDataFrame(rows, "media_id long, content binary").repartition(4)).collect()}


def test_edited_copies_are_found_and_others_are_not(found):
    groups = {}
    for i, r in found.items():
        groups.setdefault(r["group_id"], set()).add(i)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset({1, 20, 24, 25}), frozenset({2, 21}), frozenset({3, 22}), frozenset({4, 23}), frozenset({53, 54})}
    assert found[50]["n_keypoints"] == found[51]["n_keypoints"] == found[52]["n_keypoints"] == found[53]["n_keypoints"] == 0
    assert found[0]["n_keypoints"] > 10


def test_groups_equal_comparing_all_pairs(found):
    images = gallery()
    ids = sorted(images)
    parts = [M.features(M.decode(M.encode(images[i]))) for i in ids]
    m = np.eye(len(ids), dtype=bool)
    for a in range(len(ids)):
        for b in M.links(parts[a], parts):
            m[a, b] = m[b, a] = True
    for a, i in enumerate(ids):
        reach, front = {a}, [a]
        while front:
            front = [k for k in np.flatnonzero(m[front].any(0)).tolist() if k not in reach]
            reach.update(front)
        assert found[i]["group_id"] == min(ids[k] for k in reach)


def test_near_descriptors_share_a_key():
    r = np.random.default_rng(1)
    d = r.integers(0, 2**63, (200, 2), np.uint64)
    e = d.copy()
    for row in e:
        for bit in r.choice(128, 4, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    assert (M.table_keys(d) == M.table_keys(e)).any(1).all()


def test_pictures_and_empty_table(spark):
    v = spark.createDataFrame([(1, [0.5, -1.0] * 32), (2, None)], "vec_id long, embedding array<float>")
    got = {r["media_id"]: r["content"] for r in M.pictures(v).collect()}
    assert M.decode(bytes(got[1])).shape == (64, 64) and got[2] is None
    assert M.image_copies(spark.createDataFrame([], "media_id long, content binary")).count() == 0


def test_groups_are_joined_without_comparing_their_insides(monkeypatch):
    parts = [M.features(texture(1)), M.features(texture(2)), M.features(texture(1)[8:, 8:]), M.features(texture(3))]
    assert M.join_groups(parts, np.array([0, 1, 2, 3])) in ([(0, 2)], [(2, 0)])
    assert M.join_groups(parts, np.array([0, 1, 0, 3])) == []


def described(rows):
    """A picture whose rows are corners: a descriptor of 16 bytes and a place."""
    return M.encode(np.concatenate([rows, np.arange(len(rows))[:, None] * 7 % 256, np.arange(len(rows))[:, None] * 11 % 256], 1))


@pytest.mark.parametrize("holders", [1, 12])
def test_copies_meet_though_smaller_images_head_each_of_their_keys(spark, monkeypatch, holders):
    def features(grey):
        if grey is None:
            return np.zeros((0, 2), np.uint64), np.zeros((0, 4), np.float32)
        n = len(grey)
        return np.ascontiguousarray(grey[:, :16].astype(np.uint8)).view(np.uint64), np.concatenate([grey[:, 16:18], np.ones((n, 1)), np.zeros((n, 1))], 1).astype(np.float32)

    monkeypatch.setattr(M, "features", features)
    r = np.random.default_rng(3)
    shared = r.integers(0, 256, (10, 16))
    rows = []
    for i in range(10 * holders):
        mine = r.integers(0, 256, (10, 16))
        mine[0] = shared[i % 10]
        rows.append((i, described(mine)))
    for i in (1000, 1001):
        rows.append((i, described(np.concatenate([shared, r.integers(0, 256, (2, 16))]))))
    got = {x["media_id"]: x["group_id"] for x in M.image_copies(spark.createDataFrame(rows, "media_id long, content binary")).collect()}
    assert got == {**{i: i for i in range(10 * holders)}, 1000: 1000, 1001: 1000}


def test_two_images_of_a_cluster_are_compared_once(monkeypatch):
    compared = []
    monkeypatch.setattr(M, "links", lambda one, others, *both: compared.extend((one, x) for x in others) or [])
    assert M.join_groups(list("abcde"), np.array([0, 1, 2, 3, 3])) == []
    assert sorted("".join(sorted(x)) for x in compared) == ["ab", "ac", "ad", "ae", "bc", "bd", "be", "cd", "ce"]


def test_images_of_different_blocks_alone_meet_in_their_cell(monkeypatch):
    compared = []
    monkeypatch.setattr(M, "links", lambda one, others, *both: compared.extend((one, x) for x in others) or [])
    assert M.join_groups(list("abcd"), np.arange(4), np.array([0, 0, 1, 1])) == []
    assert sorted("".join(sorted(x)) for x in compared) == ["ac", "ad", "bc", "bd"]


def test_close_corners_equal_counting_bits():
    r = np.random.default_rng(5)
    d = r.integers(0, 2**63, (300, 2), np.uint64)
    e = np.concatenate([d[:100] ^ (np.uint64(1) << r.integers(0, 64, (100, 2), np.uint64)), r.integers(0, 2**63, (500, 2), np.uint64)])
    e[:50, 1] ^= np.uint64(0x7FFF)  # one bit, and 14 to 16 others
    far = np.bitwise_count(d[:, None] ^ e[None]).astype(int).sum(2)
    assert [x.tolist() for x in M.close(d, e)] == [x.tolist() for x in np.nonzero(far <= M.MATCH_BITS)]
    assert [len(x) for x in M.close(d, e[:0])] == [len(x) for x in M.close(d[:0], e)] == [0, 0]


def test_an_image_of_many_pairs_is_not_sent_with_each_of_them(spark, monkeypatch):
    def features(grey):
        n = len(grey)
        return np.ascontiguousarray(grey[:, :16].astype(np.uint8)).view(np.uint64), np.concatenate([grey[:, 16:18], np.ones((n, 1)), np.zeros((n, 1))], 1).astype(np.float32)

    monkeypatch.setattr(M, "features", features)
    r = np.random.default_rng(8)
    shared = r.integers(0, 256, (3, 16))
    rows = [(i, described(np.concatenate([shared, r.integers(0, 256, (200, 16))]))) for i in range(32)]
    sent = lambda: spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = sent()
    got = M.image_copies(spark.createDataFrame(rows, "media_id long, content binary")).collect()
    assert {x["media_id"]: x["group_id"] for x in got} == {i: i for i in range(32)}
    # 465 pairs of 32 images of 4 KB
    assert sent() - before < 2_500_000


def corners_of_rows(grey):
    if grey is None:
        return np.zeros((0, 2), np.uint64), np.zeros((0, 4), np.float32)
    return np.ascontiguousarray(grey[:, :16].astype(np.uint8)).view(np.uint64), np.concatenate([grey[:, 16:18], np.ones((len(grey), 1)), np.zeros((len(grey), 1))], 1).astype(np.float32)


def test_pairs_of_one_group_are_not_listed(spark, monkeypatch):
    made = []

    def counted(df, tidy=False):
        df = cut(df, tidy)
        made.append(df.count())
        return df

    cut = M.cut
    monkeypatch.setattr(M, "features", corners_of_rows)
    monkeypatch.setattr(M, "cut", counted)
    r = np.random.default_rng(4)
    shared, rows = r.integers(0, 256, (12, 16)), []
    for i in range(200):  # near copies: keys of about 26 of them each, other ones in each key
        mine = shared.copy()
        for c in mine:
            for bit in r.choice(128, 5, replace=False):
                c[bit // 8] ^= 1 << bit % 8
        rows.append((i, described(mine)))
    got = M.image_copies(spark.createDataFrame(rows, "media_id long, content binary")).collect()
    assert {x["media_id"]: x["group_id"] for x in got} == dict.fromkeys(range(200), 0)
    # 19,900 pairs
    assert max(made) <= 10 * len(rows)


def test_pairs_of_different_groups_are_compared_in_both_directions(spark, monkeypatch):
    monkeypatch.setattr(M, "features", corners_of_rows)
    monkeypatch.setattr(M, "links", lambda one, others, both=False: list(range(len(others))) if both else [])
    r = np.random.default_rng(6)
    shared = r.integers(0, 256, (3, 16))
    rows = [(i, described(np.concatenate([shared[: 3 if i < 3 else 1], r.integers(0, 256, (9, 16))]))) for i in range(1, 5)]
    got = M.image_copies(spark.createDataFrame(rows, "media_id long, content binary")).collect()
    assert {x["media_id"]: x["group_id"] for x in got} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_a_copy_of_a_weakly_textured_area_is_found():
    strong, weak = texture(31, 200, 200), texture(32, 200, 200) * 0.3 + 80
    whole = M.features(M.decode(M.encode(np.concatenate([strong, weak], 1))))
    part = M.features(M.decode(M.encode(weak[40:160, 40:160])))
    assert M.links(part, [whole]) == [0] and M.links(whole, [part]) == [0]
    assert M.links(part, [M.features(strong), M.features(texture(33, 200, 200))]) == []


def test_png_contents_are_read():
    from meshframe.sources.files import encode_png

    grey = np.arange(30 * 40, dtype=np.uint8).reshape(30, 40)
    raw = encode_png(np.repeat(grey[..., None], 3, 2))
    assert (M.decode(raw) == grey).all()
    assert M.decode(raw[:60]) is None and M.decode(raw[:8]) is None and M.decode(raw[:40] + b"x" * 40) is None
