"""A small queue simulation, the yardstick for the crawl plan."""

from collections import deque


def simulate(seed, max_depth, max_pages, links, fetch, blocked):
    """links: url -> ordered in-scope targets; fetch: url -> ok; blocked: set."""
    queue, seen = deque([(seed, 0)]), {seed}
    pages, failed, status = [], [], "success"
    while queue:
        url, depth = queue.popleft()
        if len(pages) >= max_pages:
            status = "max_pages_hit"
            continue
        if url in blocked:
            continue
        if not fetch.get(url, False):
            failed.append(url)
            continue
        new = []
        if depth < max_depth:
            for target in links.get(url, []):
                if target not in seen:
                    seen.add(target)
                    new.append(target)
                    queue.append((target, depth + 1))
        else:
            status = "max_depth_hit"
        pages.append((url, depth, len(new)))
    return pages, failed, status
