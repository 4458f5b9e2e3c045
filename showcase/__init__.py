"""Every operator as a query over the test tables, with the equivalent plain SQL."""
