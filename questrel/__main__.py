"""python -m questrel: query NAME DIR | queries | dump-log PATH TOPIC PARTITION | verify-token SECRET_HEX TEXT"""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from .operators import admin, tokens
from .plans import catalog
from .session import get_session
from .sources import logs


def main(args: list[str]) -> int:
    match args:
        case ["queries"]:
            print(*sorted(catalog.QUERIES), sep="\n")
        case ["query", name, path]:
            for line in catalog.QUERIES[name](get_session(), path).toJSON().toLocalIterator():
                print(line)
        case ["dump-log", path, topic, partition]:
            log = logs.read_log(get_session(), path).where((F.col("topic") == topic) & (F.col("partition") == int(partition)))
            for r in admin.dump_log(log).toLocalIterator():
                print(r.line)
        case ["verify-token", secret, text]:
            d = get_session().createDataFrame([(text,)], "x string").withColumn("t", tokens.unmarshal("x"))
            row = d.select(tokens.verify(tokens.tag_of("t"), tokens.id_of("t"), bytes.fromhex(secret)).alias("ok"), F.hex(tokens.id_of("t")).alias("id")).first()
            print(f"id {row.id.lower()}" if row.ok else "corrupt" if row.ok is None else "bad MAC")
            return 0 if row.ok else 1
        case _:
            print(__doc__)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
