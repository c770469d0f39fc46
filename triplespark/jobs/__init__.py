"""Jobs over ordinary tables, and the queries made of them."""
