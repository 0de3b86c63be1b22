"""DataFrame -> DataFrame operators (cleaning, KPIs, charts, cohorts, insights, ML)."""
