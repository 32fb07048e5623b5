"""Derived relations of C functions, as one SQL text for Spark and for DuckDB.

The tables hold no C code, so `c_functions` assembles a function from each row of `part`: statements come and go
with the key modulo small coprime numbers, so that every pattern, depth, length and parameter count occurs in some rows.
"""

from __future__ import annotations

_NAMES = (
    "init_device", "getCount", "set_value", "read_block", "writeBlock", "free_buffer", "destroyNode", "cleanup_all", "create_list",
    "alloc_page", "do_work", "offset_calc", "probe", "targetMode", "s_helper", "checkState",
)

_PARAMS = ("void", "", "int n", "struct device *dev, int n", "char *buf, int n, long flags", "int a, int b, int c, int n, int e, int f")

#: modulus, remainder, statement.
_STATEMENTS = (
    (2, 0, "    int i = 0;"), (3, 1, "    char *p = NULL;"), (5, 1, "    static int calls = 0;"), (7, 2, "    FILE *f = fopen(name, mode);"),
    (11, 3, '    printf("value", n);'), (13, 4, "    p = malloc(sizeof(struct node));"), (13, 5, "    free(p);"), (13, 6, "    memcpy(dst, src, n);"),
    (17, 1, "    writel(BIT(3) | 0x1F, base->regs);"), (17, 2, "    val = readl(base + 4) & 0xFF;"), (17, 3, "    volatile int *reg_ptr = dev->reg_base;"),
    (17, 4, "    regmap_update_bits(map, 0x10, GENMASK(7, 0), 1 << 4);"), (17, 5, "    devm_kzalloc(dev, n, 0);"), (17, 6, "    request_irq(irq, handler, 0, name, dev);"),
    (17, 7, "    spin_lock_irqsave(lock, flags); spin_unlock_irqrestore(lock, flags);"), (17, 8, "    mutex_lock(lock); mutex_unlock(lock); atomic_inc(count);"),
    (17, 9, "    spi_sync(spi, msg); spi_write(spi, buf, n);"), (17, 10, "    i2c_transfer(adap, msgs, 2);"), (17, 11, "    gpiod_set_value(desc, 1);"),
    (17, 12, "    watchdog_register_device(wdd); mod_timer(t, 10);"), (17, 13, "    struct platform_device *pdev = to_pdev(dev);"), (17, 14, "    module_init(driver);"),
    (17, 15, "    __asm__(code);"), (17, 16, "    if (unlikely(n)) { n = 0; }"), (19, 1, "    socket(domain, type, 0); bind(fd, addr, len);"), (19, 2, "    inet_pton(fam, src, dst);"),
    (19, 3, "    g_total += n;"), (19, 4, "    extern int shared;"), (19, 5, "    assert(n > 0);"), (19, 6, "    WARN_ON(n);"), (19, 7, "    perror(name); errno = 0;"),
    (23, 1, "    for (i = 0; i < n; i++) { total += a[i]; }"), (23, 2, "    while (n > 0) { n--; }"), (23, 3, "    for (i = 0; i < n; i++) { while (k) { if (k > 2) { if (k == 9) { k--; } } } }"),
    (23, 4, "    switch (n) { case 1: n = 2; break; case 2: n = 3; break; default: break; }"), (23, 5, "    do { n++; } while (n < 10 && k);"), (23, 6, "    if (n < 0) { goto out; } else if (n == 1) { n = 2; }"),
    (29, 1, "    if (ptr == NULL) { return -1; }"), (29, 2, "    if (rc < 0) { return NULL; }"), (29, 3, "    if (!ok) { return 0; }"), (29, 4, "    /* if the loop ends, return */"),
    (29, 5, "    n = x->left + y.right + &z;"), (29, 6, "    return false;"), (29, 7, "    hardware port = device + global;"), (29, 8, "    exit(1);"), (29, 9, "    __packed int q; barrier(); mb();"),
)


def _code() -> str:
    name = "CASE CAST(p_partkey % 16 AS INT) " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"
    params = "CASE CAST((p_partkey + floor(p_partkey / 16)) % 6 AS INT) " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PARAMS)) + " END"
    nl = "chr(10)"
    parts = ["CASE WHEN p_partkey % 4 = 1 THEN 'static ' WHEN p_partkey % 4 = 2 THEN 'static inline ' ELSE '' END", "'int '", name, "'('", params, f"')' || {nl} || '{{' || {nl}"]
    parts += [f"CASE WHEN p_partkey % {m} = {r} THEN '{s}' || {nl} ELSE '' END" for m, r, s in _STATEMENTS]
    parts.append(f"CASE WHEN p_partkey % 9 = 8 THEN repeat('    n += 1;' || {nl}, CAST(p_partkey % 61 AS INT)) ELSE '' END")
    parts.append(f"CASE WHEN p_partkey % 3 = 0 THEN '    return n;' || {nl} ELSE '' END")
    parts.append("'}'")
    return " || ".join(parts)


_NAME = "CASE CAST(p_partkey % 16 AS INT) " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"

C_FUNCTIONS = f"""
SELECT CAST(p_partkey AS BIGINT) AS fn_id, {_NAME} AS function_name, {_code()} AS function_code,
  'src/f' || CAST(CAST(floor(p_partkey / 10) AS BIGINT) AS STRING) || '.c' AS file_path
FROM part
"""

#: What stands before the functions of a file, with traps for readers of braces; it has 6 lines.
_HEADER = ("#include <stdio.h>", "#define WRAP(x) do { x; } while (0)", "/* not a function: int f(void) { */", "int proto(int a);", "static const int table[] = { 1, 2 };", "")
HEADER_LINES = len(_HEADER)
_HEAD_SQL = " || ".join(f"'{line}' || chr(10)" for line in _HEADER)

C_FILES_SPARK = f"""
SELECT file_path, {_HEAD_SQL} || array_join(transform(array_sort(collect_list(struct(fn_id, function_code))), x -> x.function_code), chr(10) || chr(10)) || chr(10) AS content
FROM ({C_FUNCTIONS}) GROUP BY file_path
"""

C_FILES_DUCK = f"""
SELECT file_path, {_HEAD_SQL} || string_agg(function_code, chr(10) || chr(10) ORDER BY fn_id) || chr(10) AS content
FROM ({C_FUNCTIONS}) GROUP BY file_path
"""

DOC_TAGS = """
SELECT d.doc_id, CASE WHEN l.quality = 1 AND l.toxic = 1 THEN 'quality,toxic,' || d.lang WHEN l.quality = 1 THEN 'quality,' || d.lang WHEN l.toxic = 1 THEN 'toxic,' || d.lang ELSE d.lang END AS tag_text
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""
