"""The dedup rules told one article at a time, for tests only."""

from datetime import timedelta

TTL = timedelta(hours=24)


class Model:
    """Keeps what a run keeps; articles are dicts with seq, id, url, title, vec, text."""

    def __init__(self, threshold, similarity):
        self.threshold, self.similarity = threshold, similarity
        self.urls, self.titles, self.last_add = set(), set(), None
        self.store = {}  # id -> [vec, last_update]

    def process(self, articles, now):
        if self.last_add is not None and now - self.last_add >= TTL:
            self.urls, self.titles = set(), set()
        return {a["seq"]: self._one(a, now) for a in sorted(articles, key=lambda a: a["seq"])}

    def _one(self, a, now):
        if a.get("extraction_error"):
            return ("failed", False, None, 0.0)
        if a["url"] in self.urls or a["title"] in self.titles:
            return ("duplicate", True, a["id"], 0.0)
        if a["text"] == "":
            return ("error", False, None, 0.0)
        best, score = None, 0.0
        for id_, (vec, at) in self.store.items():
            if at < now - TTL:
                continue
            sim = round(self.similarity(a["vec"], vec), 6)
            if sim >= self.threshold and sim > 0 and (sim > score or (sim == score and id_ < best)):
                best, score = id_, sim
        self.urls.add(a["url"])
        self.titles.add(a["title"])
        self.last_add = now
        if best is not None:
            self.store[best][1] = now
            return ("duplicate", False, best, score)
        self.store[a["id"]] = [a["vec"], now]
        return ("new", False, None, 0.0)
