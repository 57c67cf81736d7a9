"""biblioflux.functions"""
