"""millrace: turns record-oriented data into typed DataFrames through chainable stages that compile to Catalyst."""
