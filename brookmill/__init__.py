"""Shop-behaviour analytics as Spark jobs: sessions, page conversion, area top products, ad clicks."""
