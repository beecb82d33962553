"""Registered queries: the library run over the supplied tables, with the equal SQL.

The supplied tables stand in for county feeds: customers are parcels, nations decide
the county, orders are addresses, sales and permits, line items are land records and
page rows. Every query reads whole tables.
"""
