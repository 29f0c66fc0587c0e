"""Derive source files from ``orders``: one file per order, its project being the customer.

The text of a file depends only on its own row, so deriving is a projection: no shuffle, no group, and it works on
a stream of orders as well. Snippets are short pieces of invented Java; ``#K#`` becomes the order key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.sources.partitions import spread

_LONG_BODY = "\n".join(f"        total = total + step{i};" for i in range(56))

SNIPPETS = [
    # 0 joined SQL text
    '    List<Row> find#K#(String id) {\n        String q = "SELECT * FROM t#K# WHERE id = " + id;\n        return db.run(q);\n    }',
    # 1 statement with a joined argument
    '    void drop#K#(String t) {\n        Statement.executeUpdate("DELETE FROM " + t);\n    }',
    # 2 command with a joined argument, over two lines
    '    void run#K#(String arg) throws IOException {\n        Runtime.getRuntime().exec("ls "\n            + arg);\n    }',
    # 3 secrets: a real one, a placeholder, one in a comment
    '    String password = "hunter#K#hunter";\n    String secret = "change-me-now";\n    // password = "inacomment#K#";\n    String api_key = "k#K#-0123456789";',
    # 4 weak hashes
    '    byte[] sum#K#(byte[] b) {\n        return MessageDigest.getInstance("MD5").digest(b);\n    }\n    // MessageDigest.getInstance("SHA-1")',
    # 5 random numbers
    '    int roll#K#() {\n        Random r = new Random();\n        return r.nextInt() > 3 ? 1 : 0;\n    }',
    # 6 native deserialisation
    '    Object read#K#(InputStream in) throws Exception {\n        ObjectInputStream ois = new ObjectInputStream(in);\n        return ois.readObject();\n    }',
    # 7 endpoint without authorisation
    '    @GetMapping("/orders/#K#")\n    Order order#K#(Long id) {\n        Order found = store.byKey(id);\n        return found;\n    }\n' + "    // " + "-" * 260,
    # 8 endpoint with authorisation
    '    @PostMapping("/orders/#K#")\n    @PreAuthorize("hasRole()")\n    public void save#K#(Order o) {\n        store.put(o);\n    }',
    # 9 csrf, on one line and over two
    '    void web#K#(Http http) {\n        http.csrf().disable();\n        http.csrf()\n            .disable();\n    }',
    # 10 trust manager with an empty check
    '    TrustManager tm#K# = new X509TrustManager() {\n        public void checkClientTrusted(X[] c, String a) { }\n        public void checkServerTrusted(X[] c, String a) {\n        }\n    };',
    # 11 password comparison
    '    boolean login#K#(String password, User u) {\n        return u.getPassword().equals(password) || password.equals("x");\n    }',
    # 12 secret in a log call
    '    void trace#K#(String token) {\n        log.info("user {} has {}", user, token);\n        log.warn("token in text only");\n    }',
    # 13 LDAP filter
    '    void look#K#(String name) {\n        DirContext ctx = open();\n        String base = "ou=people";\n        ctx.search(base, "(cn=" + name + ")");\n    }',
    # 14 XML factories
    '    Doc parse#K#(InputStream in) {\n        return DocumentBuilderFactory.newInstance().newDocumentBuilder().parse(in);\n    }',
    # 15 prints
    '    void show#K#() {\n        System.out.println("order #K#");\n        System.err.println("bad #K#");\n    }',
    # 16 empty catch on one line and over two
    '    void quiet#K#() {\n        try {\n            go();\n        } catch (Exception e) {}\n        try {\n            go();\n        } catch (Exception e) {\n        }\n    }',
    # 17 work notes
    '    // TODO: order #K#\n    // fixme later\n    /* TODO inside a block */\n    int open#K# = 1;',
    # 18 outdated calls
    '    @Deprecated\n    public Date when#K#() {\n        StringBuffer sb = new StringBuffer();\n        return new Date();\n    }',
    # 19 addresses
    '    String home = "https://shop#K#.example.com/x";\n    String host = "10.0.0.1";\n    String version = "1.2.3";',
    # 20 unchecked result
    '    String town#K#(Long id) {\n        return repo.findById(id).getAddress(0).town();\n    }',
    # 21 shared state
    '    private static int counter#K# = 0;\n    private static final int LIMIT = 5;',
    # 22 type tests
    '    boolean kind#K#(Object o) {\n        return o instanceof A || o instanceof B || o instanceof C;\n    }\n    boolean kind2(Object o) {\n        return o instanceof A\n            || o instanceof B\n            || o instanceof C;\n    }',
    # 23 many parameters
    '    public static int mix#K#(int a, int b, Map<String, List<Integer>> c, int d, int e, final int f) {\n        return a + b + d + e + f;\n    }',
    # 24 branches and nesting
    '    int deep#K#(int n, List<String> xs) {\n        if (n > 0) {\n            for (int i = 0; i < n; i++) {\n                while (n > i) {\n                    if (n == 3) {\n                        try {\n                            n--;\n                        } catch (Exception e) {\n                            n = 0;\n                        }\n                    }\n                }\n            }\n        } else if (n < -5) {\n            return 1;\n        } else if (n < -9) {\n            return 2;\n        }\n        for (String x : xs) {\n            n = x.isEmpty() ? n : n + 1;\n        }\n        switch (n) {\n            case 1:\n                return 4;\n            case 2:\n                return 5;\n            default:\n                return 6;\n        }\n    }',
    # 25 long method
    "    long slow#K#() {\n        long total = 0;\n" + _LONG_BODY + "\n        return total;\n    }",
    # 26 block comments
    '    /*\n     * Order #K#\n     * if (x) { while (y) }\n     */\n    int a#K# = 1; /* tail */\n    /** one line */\n',
    # 27 literals that look like code
    "    char q = '\"';\n    String s#K# = \"a \\\" // not a comment /* nor this\";\n    char b = '\\'';\n\n    String u = \"unterminated\n    int after#K# = 2;",
    # 28 names of all kinds
    '    int orderKey = #K#;\n    int order_key = #K#;\n    static final int ORDER_KEY = #K#;\n    OrderKey<? extends Key> OrderKey_#K#;\n    import x.y;',
    # 29 do-while, lambda, anonymous class
    '    Runnable task#K#(int n) {\n        do {\n            n--;\n        } while (n > 0);\n        return new Runnable() {\n            public void run() {\n                if (ready) fire();\n                xs.forEach(x -> {\n                    if (x > 1) stop();\n                });\n            }\n        };\n    }',
    # 30 plain code
    '    int add#K#(int a, int b) {\n        return a + b;\n    }\n\n',
]
DIRECTORIES = ["app/src/main/shop", "app/src/test/shop", "lib/core", "build/gen", "web\\ui", "test/unit", "svc/api"]
EXTENSIONS = [".java", ".java", ".java", ".py", ".java", ".js", ".java", ".kt", ".java", ".c", ".java", ".md", ".xml"]
N = len(SNIPPETS)
BIG_EVERY, BIG_AT, BIG_PIECES = 331, 5, 90


def _array(values):
    return F.array(*[F.lit(v) for v in values])


def source_files_from(orders: DataFrame) -> DataFrame:
    """(job_id, path, content) from any frame, batch or stream, with o_orderkey and o_custkey."""
    key = F.col("o_orderkey")
    text_key = key.cast("string")
    count = F.when(key % BIG_EVERY == BIG_AT, BIG_PIECES).otherwise((key % 3 + 1)).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.element_at(_array(SNIPPETS), ((key * 7 + i * 11 + F.floor(key / 32)) % N + 1).cast("int")),
    )
    body = F.concat(
        F.lit("package shop.m#K#;\n\nimport java.util.List;\nimport java.io.*;\n\npublic class C#K# {\n"),
        F.array_join(pieces, "\n"),
        F.lit("\n}\n"),
        F.when(key % 5 == 0, "\n\n").otherwise(""),
    )
    return orders.select(
        F.concat(F.lit("job-"), F.col("o_custkey").cast("string")).alias("job_id"),
        F.concat(
            F.element_at(_array(DIRECTORIES), (key % len(DIRECTORIES) + 1).cast("int")),
            F.lit("/C"), text_key,
            F.element_at(_array(EXTENSIONS), (key % len(EXTENSIONS) + 1).cast("int")),
        ).alias("path"),
        F.replace(body, F.lit("#K#"), text_key).alias("content"),
    )


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_files_from(spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")))


def quote(text: str) -> str:
    """A SQL string literal; line breaks and other control characters are written with chr()."""
    out, plain = [], ""
    for ch in text:
        if ch in "\n\r\t\x01":
            if plain:
                out.append("'" + plain.replace("'", "''") + "'")
                plain = ""
            out.append(f"chr({ord(ch)})")
        else:
            plain += ch
    if plain or not out:
        out.append("'" + plain.replace("'", "''") + "'")
    return out[0] if len(out) == 1 else "(" + " || ".join(out) + ")"


def source_files_sql() -> str:
    """The same derivation as a SQL query."""
    lists = {n: "[" + ", ".join(quote(v) for v in vs) + "]" for n, vs in
             (("s", SNIPPETS), ("d", DIRECTORIES), ("e", EXTENSIONS))}
    return f"""
    SELECT 'job-' || o_custkey AS job_id,
           ({lists['d']})[(o_orderkey % {len(DIRECTORIES)} + 1)::INT] || '/C' || o_orderkey
             || ({lists['e']})[(o_orderkey % {len(EXTENSIONS)} + 1)::INT] AS path,
           replace({quote("package shop.m#K#;" + chr(10) * 2 + "import java.util.List;" + chr(10) + "import java.io.*;"
                          + chr(10) * 2 + "public class C#K# {" + chr(10))}
             || array_to_string(list_transform(
                  range(0, CASE WHEN o_orderkey % {BIG_EVERY} = {BIG_AT} THEN {BIG_PIECES} ELSE o_orderkey % 3 + 1 END),
                  lambda i: ({lists['s']})[((o_orderkey * 7 + i * 11 + o_orderkey // 32) % {N} + 1)::INT]), chr(10))
             || chr(10) || '}}' || chr(10)
             || CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || chr(10) ELSE '' END, '#K#', o_orderkey::VARCHAR) AS content
    FROM orders"""
