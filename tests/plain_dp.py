"""Full-table edit alignment, used only to check the fast helper."""


def plain_script(a, b):
    n, m = len(a), len(b)
    d = [[i + j if not (i and j) else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    i, j, out = n, m, []
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            if a[i] != b[j]:
                out.append((i, False, b[j]))
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            out.append((i, False, None))
        else:
            j -= 1
            out.append((i, True, b[j]))
    return d[n][m], out[::-1]
