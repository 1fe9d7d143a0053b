"""python -m strataloom: names the registered queries."""

from strataloom.plans import catalog


def main() -> None:
    print("Queries of strataloom:")
    for name in sorted(catalog.QUERIES):
        print(f"  {name}" + ("" if name in catalog.ORACLES else "  (without an SQL equivalent)"))


if __name__ == "__main__":
    main()
