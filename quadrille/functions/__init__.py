"""quadrille.functions"""
