"""Operators for a training-data pipeline (nothing else in the library imports this).

Rules that hold for every operator here, besides what its docstring says:

- it reads only the columns it is told to, under names of its own, so further
  columns of the input, whatever their names, change nothing and are not returned;
- an empty table gives an empty result with the same columns;
- texts are processed whole, whatever their length;
- one row out per row in, unless a search or a filter says otherwise: repeated rows
  and repeated or null ids stay;
- results are deterministic: ties are broken by id, choices by seeded hashes.
"""
